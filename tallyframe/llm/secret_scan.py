"""Secrets in the versions of a corpus: an incremental blob ledger.

A version (a path and a text, or a document) is addressed by the SHA-256 of its text, its blob. The ledger says
which rule versions have seen which blobs, and what they found:

1. Versions are reduced to distinct blobs. With a ledger their addresses alone are compared with it first: blobs with
   all of their rules in it are dropped, the others keep the list of rules that have not seen them.
2. Only those pairs are scanned; findings and pairs are what the ledger gains.
3. Old and new findings are joined back to every version of their blob.

So a text that comes back, under whatever path or in whatever number of copies, is never scanned again, and a
new rule version is applied to every blob once. A ledger on disk (:func:`scan_into`) only grows: a run appends its
findings, then its pairs, so what an interrupted run has left is scanned again and counts once. Everything is a
built-in function: no Python runs on executors. Texts to scan are shuffled once, without a ledger with copies of a blob
already put together on the map side; texts that need no scan do not move. The join back to versions carries no text,
and adaptive execution splits it where a blob has very many versions.

A missing text is the empty blob and has no findings; repeated versions get a row each; matches that fail their
rule's check are dropped without a second try; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm.native_spans import located, matches, spans_text
from tallyframe.llm.tables import content_key, free_name
from tallyframe.session import stage


@dataclass(frozen=True)
class Rule:
    """A named pattern; a new ``version`` has every blob scanned again. ``group`` of at least ``least`` code
    points makes a match a finding. ``base`` rules are the agreed ones, others are added by this scan."""

    name: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0
    base: bool = False

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"


# The agreed base patterns. Hexadecimal runs and access keys are searched with their least length,
# which finds the same runs, because a shorter run holds no longer one.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""",
         group=1, least=12, base=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}+", base=True),
    Rule("hex", r"[0-9a-f]{16,}+", base=True),
    # public formats of tokens and keys
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


@dataclass(frozen=True)
class Ledger:
    """``pairs``: blob, rule, version that were scanned. ``findings``: blob, rule, version, start, end."""

    pairs: DataFrame
    findings: DataFrame


def unseen(versions: DataFrame, rules: Sequence[Rule], ledger: Ledger) -> DataFrame:
    """``blob, todo``: blobs of ``versions`` with the ids of the rules that the ledger has not seen them with, staged."""
    every = F.array(*[F.lit(r.id) for r in rules])
    seen = ledger.pairs.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", F.col("version").cast("string"))).alias("seen"))
    keys = versions.select(content_key().alias("blob")).distinct()
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return stage(keys.join(seen, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0))


def texts_to_scan(versions: DataFrame, todo: DataFrame) -> DataFrame:
    """``blob, text, todo`` of the blobs in ``todo``."""
    texts = versions.select(content_key().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(todo, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))


def scan(versions: DataFrame, rules: Sequence[Rule] = RULES, ledger: Ledger | None = None) -> Ledger:
    """Scan what the ledger has not seen; returns the ledger's new rows alone, findings staged."""
    every = F.array(*[F.lit(r.id) for r in rules])
    if ledger is None:
        keys = versions.select(content_key().alias("blob")).distinct().withColumn("todo", every)
        blobs = versions.select(content_key().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(
            F.first("text").alias("text")).withColumn("todo", every)
    else:
        keys = unseen(versions, rules, ledger)
        blobs = texts_to_scan(versions, keys)
    rule_of = {r.name: r for r in rules}
    found = matches(blobs.withColumn("todo", F.transform("todo", lambda x: F.split_part(x, F.lit("@"), F.lit(1)))), "blob",
                    {r.name: r.pattern for r in rules}, F.col("todo"))
    passes = F.lit(False)
    for r in rules:
        match = F.regexp_extract("match", r.pattern, r.group) if r.group else F.col("match")
        passes = passes | ((F.col("kind") == r.name) & (F.length(match) >= r.least))
    version = F.create_map(*[x for r in rule_of.values() for x in (F.lit(r.name), F.lit(r.version))])
    findings = stage(located(found, "blob").filter(passes).select(
        "blob", F.col("kind").alias("rule"), version[F.col("kind")].alias("version"), "start", "end"))
    pairs = keys.select("blob", F.explode("todo").alias("id")).select(
        "blob", F.split_part("id", F.lit("@"), F.lit(1)).alias("rule"), F.split_part("id", F.lit("@"), F.lit(2)).cast("int").alias("version"))
    return Ledger(pairs, findings)


_PAIRS, _FINDINGS = "blob binary, rule string, version int", "blob binary, rule string, version int, start long, end long"


def load_ledger(spark: SparkSession, path: str) -> Ledger:
    """The ledger under ``path``; an empty one if there is none yet."""
    def table(name: str, schema: str) -> DataFrame:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{path}/{name}").distinct()

    return Ledger(table("pairs", _PAIRS), table("findings", _FINDINGS))


def append_to_ledger(path: str, gained: Ledger) -> None:
    """Add rows to the ledger under ``path``, findings first: pairs without their findings would hide a secret."""
    gained.findings.write.mode("append").parquet(f"{path}/findings")
    gained.pairs.write.mode("append").parquet(f"{path}/pairs")


def scan_into(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> Ledger:
    """Scan what the ledger under ``path`` has not seen, append that, and return the whole ledger."""
    append_to_ledger(path, scan(versions, rules, load_ledger(versions.sparkSession, path)))
    return load_ledger(versions.sparkSession, path)


def findings_by_path(versions: DataFrame, findings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every version with its blob's findings of the given rule versions, ordered by start, then rule.

    Columns of ``versions`` called blob or spans are replaced. ``spans`` is an array of ``start, place, kind, end``, where ``place`` is the rule's place in ``rules``.
    """
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.id), F.lit(i))])
    # staged, so that the join below has two plain sides and a blob of very many versions can be split
    listed = stage(findings.withColumn("place", place[F.concat_ws("@", "rule", F.col("version").cast("string"))]).filter(
        F.col("place").isNotNull()).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(
            F.col("start"), F.col("place"), F.col("rule").alias("kind"), F.col("end")))).alias("spans")))
    paths = versions.select(*[c for c in versions.columns if c not in ("text", "blob", "spans")], content_key().alias("blob"))
    return paths.join(listed, "blob", "left").withColumn("spans", F.coalesce(
        "spans", F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")))


def report(docs: DataFrame) -> DataFrame:
    versions = docs.select("doc_id", "text")
    found = findings_by_path(versions, scan(versions).findings)
    base = [r.name for r in RULES if r.base]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(spans_text(F.filter(
        "spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def documents_without_secrets(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no rule finds anything, with all their columns; those without a text stay."""
    blob = free_name(docs, "__blob")
    hit = stage(scan(docs.select("doc_id", "text")).findings.select(F.col("blob").alias(blob)).distinct())
    return docs.join(hit, content_key() == F.col(blob), "left_anti")


REPORT_SQL = r"""
with rules(kind, place, pattern, grp, least, base) as (values
  ('assign', 0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 12, true),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 18, true),
  ('hex', 2, '[0-9a-f]+', 0, 16, true),
  ('github', 3, 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 0, false),
  ('slack', 4, 'xox[abprs]-[A-Za-z0-9-]{10,}', 0, 0, false),
  ('jwt', 5, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 0, false),
  ('pem', 6, '-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----', 0, 0, false)),
docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
found as (
  select r, kind, place, least, base, m, coalesce(g, m) as g, string_split_regex(text, pattern) as gaps
  from (
    select d.r, u.kind, u.place, u.least, u.base, u.pattern, d.text,
      CASES_0 as m, CASES_1 as g
    from docs d, rules u)
  where len(m) > 0),
pieces as (
  select r, kind, place, least, base, i, m[i] as match, g[i] as part, length(gaps[i]) + length(m[i]) as step
  from (select *, unnest(range(1, len(m) + 1)) as i from found)),
placed as (
  select *, sum(step) over (partition by r, place order by i) as stop from pieces),
spans as (
  select r, kind, place, base, (stop - length(match))::bigint as start, stop::bigint as stop
  from placed where length(part) >= least),
listed as (
  select r, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
    count(*) filter (where kind = 'hex') as n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) filter (where base), '') as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) as spans
  from spans group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
  coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(l.spans, '') as spans
from docs left join listed l using (r)
"""


def _with_cases(sql: str) -> str:
    """DuckDB wants constant patterns: one branch per rule, with the whole match or the rule's group."""
    rules = {line.strip()[2:].split("'")[0]: line.strip() for line in sql.split("\n") if line.strip().startswith("('")}
    patterns = {k: line[line.index(", '") + 2:line.rindex("', ") + 1] for k, line in rules.items()}
    whole = " ".join(f"when '{k}' then regexp_extract_all(d.text, {p}, 0)" for k, p in patterns.items())
    part = f"when 'assign' then regexp_extract_all(d.text, {patterns['assign']}, 1)"
    gaps = " ".join(f"when '{k}' then string_split_regex(text, {p})" for k, p in patterns.items())
    return sql.replace("CASES_0", f"case u.kind {whole} end").replace("CASES_1", f"case u.kind {part} end").replace(
        "string_split_regex(text, pattern)", f"case kind {gaps} end").replace(
        "select r, kind, place, least, base, m, coalesce(g, m)", "select r, kind, place, least, base, m, coalesce(g, m)")


REPORT_SQL = _with_cases(REPORT_SQL)
