"""URL filters: rules by host and path, and for all other URLs a tree of path templates for each host.

The tree is grown level by level, all hosts at once, from aggregates:

- a segment stays in a template if enough URLs of its parent have it, all others
  are variable and become one wildcard ``*``; so a parent keeps ``MOST`` at most;
- segments of one parent whose labels and whose ends are statistically similar
  (Hoeffding's bound on both shares) merge into one branch, as do their subtrees;
- a template's share of blocked labels is smoothed towards its parent's, the
  host's towards the share in all URLs. Above a half, the template is rejected.

Labels are the verdicts of the rules on the URLs that one fits, so the method
carries them over to URLs that no rule fits. Segments below ``DEPTH`` count as one.
A level is two aggregates of (host, branch, segment) counts and one join with one
row for each branch, salted, as one host may hold a large part of all rows.

Cases: a null URL, or one without ``://``, has an empty host and path; a null or
repeated page_id changes nothing; URLs without any label keep their parent's share,
and without labels at all every URL is allowed. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import remove, written

DEPTH = 6  # segments of a path that have places of their own
SUPPORT = 8  # a segment that fewer URLs of its parent have is variable
MOST = 32  # so is one that less than a MOST-th of them have
LONGEST = 64  # and one of more characters
WEIGHT = 4.0  # labels that a parent's share counts for
BOUND = math.sqrt(0.5 * math.log(2 / 0.05))  # Hoeffding's, at a confidence of 95 %
SALTS = 16
WILD, END = "*", "$"


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host with its subdomains, where the path starts with ``path``; of those that fit the longest wins."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The text of the longest rule that fits, and whether it blocks (both null without one).

    Rules come from a settings file; they are one CASE expression. Of two with the same text a blocking one wins.
    """
    text, blocks = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (len(r.text), not r.allow)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, blocks = F.when(fits, rule.text).otherwise(text), F.when(fits, not rule.allow).otherwise(blocks)
    return text, blocks


def judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict; beside them the template of the URL and its smoothed share of blocked labels."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, blocks = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "blocks": blocks})
    out = templates(rows)
    verdict = F.when(F.coalesce("blocks", F.col("purity") > 0.5), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def templates(rows: DataFrame) -> DataFrame:
    """``rows`` (host, path and blocks, a label or null) with template and purity."""
    found = F.filter(F.split("path", "/"), lambda s: s != "")
    rest = F.array_join(F.slice(found, DEPTH, F.greatest(F.size(found), F.lit(1))), "/")
    parts = F.when(F.size(found) <= DEPTH, found).otherwise(F.concat(F.slice(found, 1, DEPTH - 1), F.array(rest)))
    first = written(rows.withColumns({"segs": parts, "template": F.lit("")}), "urls")
    top = first.agg(F.count("blocks").alias("labelled"), F.count_if("blocks").alias("blocked"), F.max(F.size("segs")).alias("depth")).first()
    share = F.lit(top["blocked"] / top["labelled"] if top["labelled"] else 0.0)
    hosts = first.groupBy("host", "template").agg(F.count("blocks").alias("labelled"), F.count_if("blocks").alias("blocked"))
    hosts = hosts.select("host", "template", _smoothed(F.col("blocked"), F.col("labelled"), share).alias("purity"))
    now = written(_with_nodes(first, hosts, F.col("segs")), "urls")
    remove(first.sparkSession, first)
    for level in range(0 if top["depth"] is None else top["depth"] + 1):
        last, now = now, written(_grown(now, level), "urls")
        remove(now.sparkSession, last)
    return now.drop("segs")


def _smoothed(blocked: Column, labelled: Column, parent: Column) -> Column:
    return (blocked + F.lit(WEIGHT) * parent) / (labelled + F.lit(WEIGHT))


def _with_nodes(rows: DataFrame, nodes: DataFrame, by: Column) -> DataFrame:
    """``rows`` with the columns of their node (host, template); a node's rows are dealt by ``by`` to several tasks."""
    spread = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["host", "template", "salt"], "left").drop("salt")


def _grown(rows: DataFrame, level: int) -> DataFrame:
    """``rows`` with the branch of segment ``level`` added to their templates, and its purity."""
    rows = rows.withColumn("seg", F.get("segs", F.lit(level)))
    counts = rows.where(F.size("segs") >= level).groupBy("host", "template", "purity", "seg").agg(
        F.count("*").alias("n"), F.count("blocks").alias("labelled"), F.count_if("blocks").alias("blocked"), F.count_if(F.size("segs") == level + 1).alias("ends")
    )
    gone = lambda c: F.sum(F.when(F.col("seg").isNull(), F.col(c)).otherwise(0)).alias(f"end_{c}")
    nodes = counts.groupBy("host", "template", "purity").agg(F.sum("n").alias("total"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), gone("labelled"), gone("blocked"))
    kept = _merged(_constant(counts, nodes))
    all_kept = kept.groupBy("host", "template").agg(F.collect_list(F.struct("members", "labelled", "blocked")).alias("kept"))  # MOST at most
    known = nodes.join(all_kept, ["host", "template"], "left")
    of_kept = lambda c: F.coalesce(F.aggregate("kept", F.lit(0).cast("long"), lambda a, k: a + k[c]), F.lit(0))
    wild = {c: F.col(c) - F.col(f"end_{c}") - of_kept(c) for c in ("blocked", "labelled")}
    entry = lambda k: F.struct(F.array_join(k["members"], "|").alias("branch"), _smoothed(k["blocked"], k["labelled"], F.col("purity")).alias("purity"))
    entries = F.flatten(F.transform("kept", lambda k: F.transform(k["members"], lambda m: F.struct(m.alias("key"), entry(k).alias("value")))))
    known = known.select(
        "host", "template", F.map_from_entries(entries).alias("branches"), _smoothed(wild["blocked"], wild["labelled"], F.col("purity")).alias("wild"),
        _smoothed(F.col("end_blocked"), F.col("end_labelled"), F.col("purity")).alias("end"),
    )
    chosen = F.when(F.col("seg").isNotNull(), F.try_element_at("branches", F.col("seg")))
    step = F.when(F.col("seg").isNull(), F.struct(F.lit(END).alias("branch"), F.col("end").alias("purity"))).otherwise(F.coalesce(chosen, F.struct(F.lit(WILD).alias("branch"), F.col("wild").alias("purity"))))
    out = _with_nodes(rows, known, F.col("segs")).withColumn("step", F.when(F.size("segs") >= level, step))
    return out.withColumns(
        {"template": F.when(F.col("step").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "step.branch")), "purity": F.coalesce("step.purity", "purity")}
    ).drop("seg", "step", "branches", "wild", "end")


def _constant(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The segments that stay in templates; the marks of wildcards, ends and merged branches never do."""
    often = counts.where((F.col("n") >= SUPPORT) & (F.length("seg") <= LONGEST) & ~F.col("seg").rlike(r"[*$|]"))
    return _with_nodes(often, nodes.select("host", "template", "total"), F.col("seg")).where(F.col("n") * MOST >= F.col("total"))


def _merged(segments: DataFrame) -> DataFrame:
    """(host, template, members, labelled, blocked): neighbours by label share and share of ends are one branch if both are similar.

    A parent has MOST segments at most here, and so has a window.
    """
    rates = segments.withColumns({"rate": F.try_divide(F.col("blocked").cast("double"), F.col("labelled")), "end": F.col("ends") / F.col("n")})
    order = Window.partitionBy("host", "template").orderBy(F.col("rate").asc_nulls_last(), "end", "seg")
    before = lambda c: F.lag(c).over(order)
    near = lambda value, n: F.abs(F.col(value) - before(value)) < F.lit(BOUND) * (1 / F.sqrt(n) + 1 / F.sqrt(before(n)))
    new = F.when(near("rate", "labelled") & near("end", "n"), 0).otherwise(1)  # without labels a segment stays alone
    rates = rates.withColumn("new", new).withColumn("branch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rates.groupBy("host", "template", "branch").agg(F.sort_array(F.collect_list("seg")).alias("members"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))


def judged_sql(rules: Sequence[Rule]) -> str:
    """DuckDB SQL of :func:`judged` over ``pages``, level by level."""
    by_length = sorted(rules, key=lambda r: (-len(r.text), r.allow))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN {value(r)}" for r in by_length) + " END"
    smoothed = lambda b, n, p: f"(({b}) + {WEIGHT} * ({p})) / (({n}) + {WEIGHT})"
    steps = [
        "a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)",
        f"c AS (SELECT *, {case(lambda r: repr(r.text))} AS rule, {case(lambda r: str(not r.allow).lower())} AS blocks, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM b)",
        f"d AS MATERIALIZED (SELECT row_number() OVER () AS k, page_id, host, path, rule, blocks, CASE WHEN len(segs) <= {DEPTH} THEN segs ELSE list_append(segs[1:{DEPTH - 1}], array_to_string(segs[{DEPTH}:], '/')) END AS segs FROM c)",
        "top AS (SELECT coalesce(count(*) FILTER (blocks) / nullif(count(blocks), 0), 0) AS share FROM d)",
        f"h AS (SELECT host, {smoothed('count(*) FILTER (blocks)', 'count(blocks)', 'any_value(share)')} AS purity FROM d, top GROUP BY host)",
        "r0 AS MATERIALIZED (SELECT d.*, '' AS template, purity FROM d JOIN h USING (host))",
    ]
    for i in range(DEPTH + 1):
        steps += [
            f"""n{i} AS MATERIALIZED (SELECT host, template, purity, segs[{i + 1}] AS seg, count(*) AS n, count(blocks) AS labelled, count(*) FILTER (blocks) AS blocked, count(*) FILTER (len(segs) = {i + 1}) AS ends
 FROM r{i} WHERE len(segs) >= {i} GROUP BY ALL)""",
            f"""p{i} AS (SELECT host, template, purity, sum(n) AS total, sum(labelled) AS labelled, sum(blocked) AS blocked, coalesce(sum(labelled) FILTER (seg IS NULL), 0) AS end_labelled, coalesce(sum(blocked) FILTER (seg IS NULL), 0) AS end_blocked
 FROM n{i} GROUP BY ALL)""",
            f"""s{i} AS (SELECT n{i}.*, blocked / nullif(labelled, 0) AS rate, ends / n AS edge FROM n{i} JOIN (SELECT host, template, total FROM p{i}) USING (host, template)
 WHERE n >= {SUPPORT} AND length(seg) <= {LONGEST} AND NOT regexp_matches(seg, '[*$|]') AND n * {MOST} >= total)""",
            f"""w{i} AS (SELECT *, CASE WHEN abs(rate - lag(rate) OVER o) < {BOUND!r} * (1 / sqrt(labelled) + 1 / sqrt(lag(labelled) OVER o)) AND abs(edge - lag(edge) OVER o) < {BOUND!r} * (1 / sqrt(n) + 1 / sqrt(lag(n) OVER o)) THEN 0 ELSE 1 END AS fresh
 FROM s{i} WINDOW o AS (PARTITION BY host, template ORDER BY rate NULLS LAST, edge, seg))""",
            f"g{i} AS (SELECT *, sum(fresh) OVER (PARTITION BY host, template ORDER BY rate NULLS LAST, edge, seg ROWS UNBOUNDED PRECEDING) AS branch FROM w{i})",
            f"k{i} AS MATERIALIZED (SELECT host, template, purity, list(seg) AS members, string_agg(seg, '|' ORDER BY seg) AS name, sum(labelled) AS labelled, sum(blocked) AS blocked FROM g{i} GROUP BY host, template, purity, branch)",
            f"m{i} AS (SELECT host, template, unnest(members) AS seg, name, {smoothed('blocked', 'labelled', 'purity')} AS p FROM k{i})",
            f"q{i} AS (SELECT host, template, sum(labelled) AS labelled, sum(blocked) AS blocked FROM k{i} GROUP BY ALL)",
            f"""e{i} AS (SELECT p.host, p.template, {smoothed('p.blocked - end_blocked - coalesce(q.blocked, 0)', 'p.labelled - end_labelled - coalesce(q.labelled, 0)', 'purity')} AS wild, {smoothed('end_blocked', 'end_labelled', 'purity')} AS edge
 FROM p{i} p LEFT JOIN q{i} q ON p.host = q.host AND p.template = q.template)""",
            f"""r{i + 1} AS MATERIALIZED (SELECT k, page_id, r.host, path, rule, blocks, segs, CASE WHEN len(segs) < {i} THEN r.template ELSE r.template || '/' || CASE WHEN segs[{i + 1}] IS NULL THEN '{END}' ELSE coalesce(m.name, '{WILD}') END END AS template,
 CASE WHEN len(segs) < {i} THEN purity WHEN segs[{i + 1}] IS NULL THEN e.edge ELSE coalesce(m.p, e.wild) END AS purity
 FROM r{i} r LEFT JOIN m{i} m ON r.host = m.host AND r.template = m.template AND segs[{i + 1}] = m.seg LEFT JOIN e{i} e ON r.host = e.host AND r.template = e.template)""",
        ]
    return "WITH " + ",\n".join(steps) + f"\nSELECT page_id, host, path, rule, CASE WHEN coalesce(blocks, purity > 0.5) THEN 'block' ELSE 'allow' END AS verdict, template, round(purity, 9) AS purity FROM r{DEPTH + 1}"
