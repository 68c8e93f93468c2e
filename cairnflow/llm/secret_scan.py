"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every file is addressed by the SHA-256 of its text. A ledger holds the
(blob, rule, rule version) triples that were scanned before; a scan reads only blobs with
an unseen triple, once each however many paths hold them, and joins the findings back to
all paths.

Defined cases: a null text is an empty one; an empty text has no findings; equal rows are
scanned once and each gets the findings; an empty table gives an empty result; columns
other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnflow.llm.store import stored


@dataclass(frozen=True)
class Rule:
    """A pattern; a match stands if its group has min_chars code points at least."""

    name: str
    pattern: str
    group: int
    min_chars: int
    version: int = 1


def either_case(word: str) -> str:
    """A pattern for an ASCII word in any mixture of cases, without a regex flag."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(either_case(w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))

# Fixed patterns of the contract, in its order of kinds. Runs that can only fail by being
# too short are asked for in full length at once, which gives the same matches.
RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)

LEDGER = "blob_id string, rule string, rule_version int"


@dataclass(frozen=True)
class Scan:
    paths: DataFrame  #: (path, blob_id): which blob each path holds
    findings: DataFrame  #: (blob_id, rule, rule_version, rule_order, start, end), new ones only
    scanned: DataFrame  #: LEDGER rows to append once the findings are stored


def blobs_of(docs: DataFrame, path: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(path).alias("path"), F.sha2(body, 256).alias("blob_id"), body.alias("body"))


def scan(docs: DataFrame, path: str, text: str, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> Scan:
    """Scan the blobs of docs for rules that the ledger doesn't hold for them."""
    spark = docs.sparkSession
    held = blobs_of(docs, path, text)
    blobs = held.select("blob_id", "body").dropDuplicates(["blob_id"])
    asked = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, rule_version int")
    if ledger is None:
        unseen = blobs.withColumn("todo", F.array(*[F.lit(r.name) for r in rules]))
    else:
        # only addresses, never texts, meet the ledger; a blob with nothing left to do is gone before it is read
        done = (
            ledger.join(F.broadcast(asked), ["rule", "rule_version"], "left_semi")  # as many rows as rules
            .groupBy("blob_id")
            .agg(F.collect_set("rule").alias("done"))
        )
        todo = F.array_except(F.array(*[F.lit(r.name) for r in rules]), F.coalesce("done", F.array().cast("array<string>")))
        unseen = blobs.join(done, "blob_id", "left").withColumn("todo", todo).where(F.size("todo") > 0).drop("done")

    per_rule = []
    for i, r in enumerate(rules):
        hits = F.when(F.array_contains("todo", r.name), F.regexp_extract_all("body", F.lit(r.pattern), F.lit(0)))
        per_rule.append(F.struct(F.lit(i).alias("rule_order"), F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), F.lit(r.pattern).alias("pattern"), hits.alias("hits")))
    by_rule = (
        unseen.select("blob_id", "body", F.explode(F.array(*per_rule)).alias("r"))
        .where(F.size("r.hits") > 0)
        .select("blob_id", "r.rule_order", "r.rule", "r.rule_version", "r.hits", _gaps(rules).alias("gaps"))
    )
    each = by_rule.select(
        "blob_id", "rule_order", "rule", "rule_version",
        F.posexplode(F.arrays_zip(F.col("hits").alias("hit"), F.slice("gaps", 1, F.size("hits")).alias("gap"))).alias("nth", "m"),
    )
    before = Window.partitionBy("blob_id", "rule_order").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size, upto = F.length("m.hit"), F.sum(F.length("m.gap") + F.length("m.hit")).over(before)
    whole = F.lit(False)
    for r in rules:
        part = F.regexp_extract("m.hit", r.pattern, r.group)
        whole = whole | ((F.col("rule") == r.name) & (F.length(part) >= r.min_chars))
    findings = (
        each.withColumn("end", upto)
        .where(whole)
        .select("blob_id", "rule", "rule_version", "rule_order", (F.col("end") - size).alias("start"), "end")
    )
    versions = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])
    scanned = unseen.select("blob_id", F.explode("todo").alias("rule")).withColumn("rule_version", versions[F.col("rule")])
    return Scan(held.select("path", "blob_id"), findings, scanned)


def _gaps(rules: tuple[Rule, ...]):
    """The texts between the hits; split() needs a pattern that is known beforehand."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for r in rules:
        out = out.when(F.col("r.rule") == r.name, F.split("body", r.pattern, -1))
    return out


def by_path(paths: DataFrame, findings: DataFrame, base: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per path: counts per base rule, the digest of base findings and all findings as text."""
    spans = F.array_sort(F.collect_list(F.struct("start", "rule_order", F.concat_ws(":", "rule", F.col("start").cast("string"), F.col("end").cast("string")).alias("span"), "rule")))
    per_blob = findings.groupBy("blob_id").agg(spans.alias("f"))
    names = [r.name for r in base]
    of_base = F.filter("f", lambda x: x["rule"].isin(names))
    of = lambda name: F.size(F.filter("f", lambda x: x["rule"] == name)).cast("long")
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda x: x["span"]))
    digest = per_blob.select(
        "blob_id",
        *[of(n).alias(f"n_{n}") for n in names],
        F.sha2(joined(of_base), 256).alias("base_sha256"),
        joined(F.col("f")).alias("spans"),
    )
    return paths.join(digest, "blob_id", "left").select(
        "path",
        *[F.coalesce(f"n_{n}", F.lit(0)).cast("long").alias(f"n_{n}") for n in names],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def scan_batches(batches: list[DataFrame], path: str, text: str, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> Scan:
    """Batches that arrive one after the other, each scanned for what the ledger lacks after those before it. scanned holds
    the new rows of the ledger, findings those of all batches."""
    held = None
    for docs in batches:
        now = scan(docs, path, text, rules, ledger)
        now = Scan(now.paths, stored(now.findings), stored(now.scanned))
        held = now if held is None else Scan(held.paths.union(now.paths), held.findings.union(now.findings), held.scanned.union(now.scanned))
        ledger = now.scanned if ledger is None else ledger.union(now.scanned)
    return held


def masked(docs: DataFrame, path: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in text replaced by its rule's name in brackets, and n_secrets. Overlapping secrets become one."""
    found = scan(docs, path, text, rules)
    spans = F.array_sort(F.collect_list(F.struct("start", "rule_order", "end", "rule")))
    per_blob = found.findings.groupBy("blob_id").agg(spans.alias("_spans")).withColumnRenamed("blob_id", "_blob")
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(body, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        tag = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["rule"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, tag).alias("out"))

    whole = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))))
    joined = docs.withColumn("_blob", F.sha2(body, 256)).join(per_blob, "_blob", "left")
    return joined.withColumn(text, F.when(F.col("_spans").isNotNull(), whole).otherwise(F.col(text))).withColumn("n_secrets", F.coalesce(F.size("_spans"), F.lit(0))).drop("_spans", "_blob")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of documents, which arrive in two batches: blobs of the first aren't read again in the second."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    late = F.coalesce(F.xxhash64("doc_id") < 0, F.lit(False))
    found = scan_batches([docs.where(~late), docs.where(late)], "doc_id", "text")
    return by_path(found.paths, found.findings).withColumnRenamed("path", "doc_id")


def _duck(r: Rule, order: int) -> str:
    pat = r.pattern.replace("'", "''")
    group = f"regexp_extract(h[i], '{pat}', {r.group})"
    return f"""
  SELECT doc_id, {order} AS rule_order, '{r.name}' AS rule, i,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS s,
         length(h[i]) AS n
  FROM (SELECT doc_id, h, g, unnest(generate_series(1, len(h))) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '{pat}', 0) AS h, string_split_regex(text, '{pat}') AS g
              FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))
  WHERE length({group}) >= {r.min_chars}"""


OP1_SQL = f"""
WITH f AS ({" UNION ALL ".join(_duck(r, i) for i, r in enumerate(RULES))}),
d AS (SELECT doc_id, count(*) FILTER (rule = 'assign') AS n_assign, count(*) FILTER (rule = 'access') AS n_access,
             count(*) FILTER (rule = 'hex') AS n_hex,
             string_agg(rule || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, rule_order) AS spans
      FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN d USING (doc_id)
"""
