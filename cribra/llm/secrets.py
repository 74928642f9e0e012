"""Secret scans over an incremental blob ledger, in DataFrame expressions only.

Every version of a path is content-addressed by the SHA-256 of its text. A ledger
holds, for each blob and rule version, the spans found. A scan takes the blobs
that the ledger lacks under the present rule version, reads one text for each, and
adds a row for each (without spans too, so that it is never scanned again).
Findings join back to all paths by blob.

Positions come from the matches and the text between them: the k-th match starts
after the first k gaps and k - 1 matches, a running sum over the matches of a blob.

Defined cases: a null text is the empty blob; a null path keeps its findings; a
version row that occurs twice is returned twice; several versions of one path are
several rows; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cribra.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: Java pattern, the group that is measured, and its least length."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base patterns of the contract, in its order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + EXTRA
VERSION = "rules-1"
SPANS = "array<struct<start:long,rule:int,end:long,kind:string>>"
SCHEMA = f"blob binary, rule_version string, spans {SPANS}"


def _narrowed(rule: Rule) -> str:
    """The pattern with the least length written in, where that leaves the same matches.

    True of a run of one class: a maximal run is found once, at its first character.
    """
    if rule.kind == "hex":
        return rf"[0-9a-f]{{{rule.least},}}"
    if rule.kind == "access":
        return rf"AKIA[A-Z0-9]{{{rule.least - 4},}}"
    return rule.pattern


def _matches(rule: Rule, number: int) -> F.Column:
    """Per match: rule, length of the gap before it, its length, and whether it counts."""
    p, text = F.lit(_narrowed(rule)), F.col("text")
    whole = F.regexp_extract_all(text, p, F.lit(0))
    part = F.regexp_extract_all(text, p, F.lit(rule.group))
    gaps = F.split(text, _narrowed(rule), -1)
    found = F.zip_with(
        F.slice(F.transform(gaps, F.length), F.lit(1), F.size(whole)),
        F.zip_with(F.transform(whole, F.length), F.transform(part, F.length),
                   lambda n, m: F.struct(n.alias("n"), m.alias("m"))),
        lambda g, x: F.struct(F.lit(number).alias("rule"), F.lit(rule.kind).alias("kind"),
                              g.cast("long").alias("gap"), x["n"].cast("long").alias("n"),
                              (x["m"] >= rule.least).alias("counts")))
    return F.when(text.rlike(_narrowed(rule)), found)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob``, ``spans`` of the blobs (columns ``blob``, ``text``) in which any rule matches."""
    each = F.array(*[_matches(r, k) for k, r in enumerate(rules)])
    hits = (blobs.select("blob", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("m"))
            .select("blob", F.posexplode("m").alias("i", "x")).select("blob", "i", "x.*"))
    run = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = (hits.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(run)).where("counts")
              .select("blob", F.struct((F.col("end") - F.col("n")).alias("start"), "rule", "end", "kind")
                      .alias("span")))
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, empty if there is none yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def unseen_blobs(versions: DataFrame, ledger: DataFrame, rule_version: str) -> DataFrame:
    """One path for each blob of ``versions`` (``path``, ``blob``) that was not scanned yet."""
    done = ledger.where(F.col("rule_version") == rule_version).select("blob")
    return (versions.groupBy("blob").agg(F.min("path").alias("path"))
            .join(done, "blob", "left_anti"))


def scan_versions(docs: DataFrame, ledger: DataFrame, path_col: str = "doc_id",
                  text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                  rule_version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings of every version (``path_col``, ``blob``, ``spans``), and the ledger's new rows.

    The new rows are stored; append them with ``append_ledger``. Only digests and
    paths shuffle for all versions; texts shuffle once, to meet the choice of one
    version for each unseen blob.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(path_col).alias("path"), text.alias("text"),
                        F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
    versions = stored(named.select("path", "blob"))
    chosen = stored(unseen_blobs(versions, ledger, rule_version))
    # Rows that repeat path and text would be scanned, and found, more than once.
    picked = named.alias("d").join(
        chosen.alias("c").hint("shuffle_hash"),
        (F.col("d.blob") == F.col("c.blob")) & F.col("d.path").eqNullSafe(F.col("c.path")),
        "left_semi").select("blob", "text")
    once = versions.groupBy("path", "blob").agg(F.count("*").alias("n")).where("n > 1")
    repeats = chosen.join(once, (once["blob"] == chosen["blob"])
                          & once["path"].eqNullSafe(chosen["path"]), "left_semi")
    if not repeats.isEmpty():
        again = repeats.select("blob")
        single = picked.join(again, "blob", "left_anti")
        picked = single.unionByName(picked.join(again, "blob", "left_semi").dropDuplicates(["blob"]))
    found = scan_blobs(picked, rules)
    new = stored(chosen.select("blob").join(found, "blob", "left").select(
        "blob", F.lit(rule_version).alias("rule_version"),
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans")))
    known = ledger.where(F.col("rule_version") == rule_version).unionByName(new)
    hits = known.where(F.size("spans") > 0).select("blob", "spans")
    findings = versions.join(hits, "blob", "left").select(
        F.col("path").alias(path_col), "blob",
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    return findings, new


def append_ledger(new: DataFrame, path: str) -> None:
    """Add stored new rows to the ledger at ``path``."""
    new.write.mode("append").parquet(path)


def listed(spans: F.Column) -> F.Column:
    """``kind:start:end`` of each span, comma-joined (spans are ordered by start, then rule)."""
    return F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
