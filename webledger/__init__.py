"""Audit captured web sites as Spark tables: links, verdicts, reach, robots, findings, reports."""
