"""Rules of a robots file (RFC 9309) as a table, and verdicts by longest match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_rules(text: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, pattern) of the groups naming the agent, else of the groups for everyone; several groups add up."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    agents: list[str] = []
    ruled = False
    for line in text.splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if ruled:
                agents, ruled = [], False
            agents.append(value.lower())
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow") and agents:
            ruled = True
            if value:
                for a in agents:
                    groups[a].append((key == "allow", value))
    return groups.get(agent.lower(), groups.get("*", []))


def rules_table(spark: SparkSession, robots: dict[str, str], agent: str) -> DataFrame:
    """(host, allow, pattern, regex): one row per rule; ``*`` matches anything, a final ``$`` the end."""
    rows = []
    for host, text in robots.items():
        for allow, pat in parse_rules(text, agent):
            body = pat[:-1] if pat.endswith("$") else pat
            rx = "".join(".*" if ch == "*" else ("\\" + ch if ch in r"\.^$*+?()[]{}|" else ch) for ch in body)
            rows.append((host, allow, pat, f"^{rx}{'$' if pat.endswith('$') else ''}"))
    return spark.createDataFrame(rows, "host string, allow boolean, pattern string, regex string")


def verdicts(urls: DataFrame, host: str, path: str, rules: DataFrame) -> DataFrame:
    """``urls`` with ``allowed``: the longest matching pattern decides, allow wins a tie, no match allows."""
    r = rules.withColumnRenamed("host", "__h")
    hit = urls.select(host, path).distinct().join(r, (F.col(host) == F.col("__h")) & F.rlike(F.col(path), F.col("regex")))
    best = hit.groupBy(host, path).agg(F.max(F.struct(F.length("pattern").alias("n"), "allow")).alias("b"))
    return urls.join(best, [host, path], "left").select(*urls.columns, F.coalesce(F.col("b.allow"), F.lit(True)).alias("allowed"))
