"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of a path is addressed by the SHA-256 of its content (its blob). A ledger holds
the (blob, rule, rule version) triples that were scanned already, so a run reads each distinct
content once and only with rules that have not seen it. Findings belong to blobs and are joined
back to all paths that hold the blob.

Null texts count as empty. Paths may be null or repeated; every row gets its findings. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut


class Rule(NamedTuple):
    """Leftmost non-overlapping matches of ``pattern``; ``group`` of a match has ``least`` characters or the match is dropped.

    ``hint`` is a literal that every match contains, or empty; ``base`` rules count in the digest.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str = ""
    base: bool = False


#: In the order in which spans with one start are listed.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "", True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA", True),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, "", True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
)
LEDGER = "blob string, kind string, version int"
FINDINGS = "blob string, kind string, version int, start long, end long, byte_start long, byte_end long"
#: Unseen blobs, of some 150 bytes each, that are broadcast to pick their contents out before these are shuffled.
BROADCAST_ROWS = 500_000


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def blobs_of(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct contents ``(blob, content)`` among ``versions``."""
    seen = versions.select(F.sha2(_text(text_col), 256).alias("blob"), _text(text_col).alias("content"))
    return seen.groupBy("blob").agg(F.first("content").alias("content"))


def _unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """``blobs`` with the rules still to be run on each in ``todo``; those with none are left out."""
    every = F.array(*(F.lit(f"{r.kind}@{r.version}") for r in rules))
    if ledger is None:
        return blobs.withColumn("todo", every)
    done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("done"))
    left = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
    return left.where(F.size("todo") > 0).drop("done")


def _applies(rule: Rule) -> Column:
    wanted = F.array_contains("todo", f"{rule.kind}@{rule.version}")
    held = F.contains("content", F.lit(rule.hint)) if rule.hint else F.lit(True)
    return wanted & held & F.rlike("content", F.lit(rule.pattern))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings ``(blob, kind, version, start, end, byte_start, byte_end)`` in ``blobs(blob, content, todo)``.

    Offsets count code points, and bytes of UTF-8; the end is exclusive. A match starts after the
    gaps and matches before it: splitting at a pattern gives the gaps, extracting it the matches.
    Only contents in which some rule matches are extracted and split.
    """
    hit = F.lit(False)
    for rule in rules:
        hit = hit | _applies(rule)
    none = F.lit(None).cast("array<string>")
    tried = F.array(
        *(
            F.struct(
                F.lit(rule.kind).alias("kind"),
                F.lit(rule.version).alias("version"),
                F.lit(rule.group).alias("group"),
                F.lit(rule.least).alias("least"),
                F.lit(rule.pattern).alias("pattern"),
                F.when(_applies(rule), F.regexp_extract_all("content", F.lit(rule.pattern), F.lit(0))).otherwise(none).alias("hits"),
                F.when(_applies(rule), F.transform(F.split("content", rule.pattern, -1), lambda g: F.struct(F.char_length(g).alias("long"), F.octet_length(g).alias("bytes")))).alias("gaps"),
            )
            for rule in rules
        )
    )
    each = blobs.where(hit).select("blob", F.explode(tried).alias("t")).where("t.hits is not null")
    each = each.select("blob", "t.kind", "t.version", "t.group", "t.least", F.posexplode(F.arrays_zip("t.hits", "t.gaps")).alias("at", "m"))
    each = each.where("m.hits is not null").select("*", F.char_length("m.hits").cast("long").alias("long"), F.octet_length("m.hits").cast("long").alias("bytes"))
    own = "(partition by blob, kind order by at rows between unbounded preceding and current row)"
    each = each.withColumns({"end": F.expr(f"sum(m.gaps.long) over {own} + sum(long) over {own}"), "byte_end": F.expr(f"sum(m.gaps.bytes) over {own} + sum(bytes) over {own}")})
    judged = F.lit(None).cast("int")
    for rule in rules:
        value = F.regexp_extract("m.hits", rule.pattern, rule.group) if rule.group else F.col("m.hits")
        judged = F.when(F.col("kind") == rule.kind, F.char_length(value)).otherwise(judged)
    return each.where(judged >= F.col("least")).select("blob", "kind", "version", (F.col("end") - F.col("long")).alias("start"), "end", (F.col("byte_end") - F.col("bytes")).alias("byte_start"), "byte_end")


def scan_incremental(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scan what the ledger below ``ledger_path`` has not seen and return all findings of ``rules`` in the blobs of ``versions``.

    Hashes alone are held against the ledger; contents are read for unseen blobs only, and leave
    their partition only then. Findings are appended before the ledger names their blobs as done,
    so a run that is broken off repeats work but loses nothing; repeated findings are merged when
    read.
    """
    spark = versions.sparkSession
    found_path, done_path = f"{ledger_path}/findings", f"{ledger_path}/scanned"
    hashes = cut(versions.select(F.sha2(_text(text_col), 256).alias("blob")).distinct())
    ledger = _table(spark, done_path, LEDGER)
    todo = _unseen(hashes, ledger, rules)
    if ledger is not None:
        todo = cut(todo)
    left = todo.count()
    if left:
        if ledger is None:
            blobs = _unseen(blobs_of(versions, text_col), None, rules)
        elif left <= BROADCAST_ROWS:
            wanted = versions.select(F.sha2(_text(text_col), 256).alias("blob"), _text(text_col).alias("content")).join(F.broadcast(todo), "blob")
            blobs = wanted.groupBy("blob", "todo").agg(F.first("content").alias("content"))
        else:
            blobs = blobs_of(versions, text_col).join(todo, "blob")
        scan_blobs(blobs, rules).write.mode("append").parquet(found_path)
        done = todo.select("blob", F.explode("todo").alias("t")).select("blob", F.substring_index("t", "@", 1).alias("kind"), F.substring_index("t", "@", -1).cast("int").alias("version"))
        done.write.mode("append").parquet(done_path)
        spark.catalog.refreshByPath(ledger_path)
    found = _table(spark, found_path, FINDINGS)
    if found is None:
        return spark.createDataFrame([], FINDINGS)
    current = F.lit(False)
    for rule in rules:
        current = current | ((F.col("kind") == rule.kind) & (F.col("version") == rule.version))
    return found.where(current).distinct().join(hashes, "blob", "left_semi")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at ``path``, or none where nothing was written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(schema).parquet(path)


def findings(versions: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """Findings in the blobs of ``versions`` that ``ledger(blob, kind, version)`` has not seen."""
    return scan_blobs(_unseen(blobs_of(versions, text_col), ledger, rules), rules)


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob that has findings: counts, base digest, span list, and the spans themselves."""
    number, base = F.lit(len(rules)), [r.kind for r in rules if r.base]
    for i, rule in enumerate(rules):
        number = F.when(F.col("kind") == rule.kind, F.lit(i)).otherwise(number)
    grouped = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", number.alias("no"), "end", "kind", "byte_start", "byte_end"))).alias("all"))

    def line(items: Column) -> Column:
        return F.concat_ws(",", F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    of_base = F.filter("all", lambda s: s["kind"].isin(*base))
    return grouped.select("blob", *map(count, base), F.sha2(line(of_base), 256).alias("base_sha256"), line(F.col("all")).alias("spans"), F.col("all").alias("found"))


def join_to_paths(versions: DataFrame, digests: DataFrame, text_col: str = "text") -> DataFrame:
    """``versions`` with the columns of ``digests`` for their blob, null where it has none.

    The key is the raw hash on both sides: neither side can reuse the partitioning by the hex
    form, so a content that a third of the paths share is split by adaptive execution.
    """
    right = digests.withColumnsRenamed({c: f"__{c}" for c in digests.columns})
    return versions.join(right, F.unhex(F.sha2(_text(text_col), 256)) == F.unhex("__blob"), "left")


def scan(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """One row per row of ``versions``: id, number of base findings by kind, base digest, all spans.

    With ``ledger_path`` the findings come through the ledger there, and what was found goes into it.
    """
    only = versions.select(F.col(id_col).alias("doc_id"), _text(text_col).alias("content"))
    paths = only.select("doc_id", F.sha2("content", 256).alias("blob"))
    digests = digest(scan_incremental(only, ledger_path, rules, "content") if ledger_path else findings(only, rules, "content"), rules)
    right = digests.withColumnRenamed("blob", "__blob")
    joined = paths.join(right, F.unhex("blob") == F.unhex("__blob"), "left")
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return joined.select("doc_id", *counts, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every finding in the text replaced by ``<kind>``; columns and rows stay.

    Findings that overlap are replaced together, named for the first. A null text stays null. The
    text is cut by bytes, where no character needs to be counted again for each finding.
    """
    number = F.lit(len(rules))
    for i, rule in enumerate(rules):
        number = F.when(F.col("kind") == rule.kind, F.lit(i)).otherwise(number)
    in_order = Window.partitionBy("blob").orderBy("byte_start", "no", "byte_end")
    marked = findings(docs, rules, text_col).withColumn("no", number).withColumn("reached", F.max("byte_end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    apart = F.when(F.col("byte_start") < F.col("reached"), 0).otherwise(1)
    cuts = marked.withColumn("island", F.sum(apart).over(in_order)).groupBy("blob", "island").agg(F.min("byte_start").alias("from"), F.max("byte_end").alias("to"), F.min_by("kind", F.struct("byte_start", "no")).alias("kind"))
    found = cuts.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("from", "to", "kind"))).alias("found"))
    joined = join_to_paths(docs, found, text_col)
    body, spans = F.col(text_col).cast("string").cast("binary"), F.col("__found")

    def piece(span: Column, i: Column) -> Column:
        kept = F.coalesce(F.try_element_at(spans, F.when(i > 0, i).otherwise(F.lit(None)).cast("int"))["to"], F.lit(0))
        return F.concat(F.substring(body, (kept + 1).cast("int"), (span["from"] - kept).cast("int")).cast("string"), F.lit("<"), span["kind"], F.lit(">"))

    rest = F.substring(body, (F.element_at(spans, -1)["to"] + 1).cast("int"), F.lit(2147483647)).cast("string")
    clean = F.when(spans.isNotNull() & F.col(text_col).isNotNull(), F.concat(F.array_join(F.transform(spans, piece), ""), rest)).otherwise(F.col(text_col))
    return joined.withColumn(text_col, clean).select(*docs.columns)


#: DuckDB SQL for scan() over documents.
SCAN_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, "
    + ", ".join(f"regexp_extract_all(t, $p${r.pattern}$p$, 0) AS h{i}, list_transform(string_split_regex(t, $p${r.pattern}$p$), lambda x: length(x)) AS g{i}" for i, r in enumerate(RULES))
    + " FROM d), s AS (SELECT doc_id, "
    + ", ".join(
        f"list_filter(list_transform(range(1, len(h{i}) + 1), lambda k: {{'start': (list_sum(g{i}[1:k]) + coalesce(list_sum(list_transform(h{i}[1:k - 1], lambda x: length(x))), 0))::BIGINT, 'no': {i}, "
        f"'long': length(h{i}[k]), 'value': length(regexp_extract(h{i}[k], $p${r.pattern}$p$, {r.group}))}}), lambda m: m['value'] >= {r.least}) AS s{i}"
        for i, r in enumerate(RULES)
    )
    + " FROM p), a AS (SELECT doc_id, "
    + ", ".join(f"len(s{i})::BIGINT AS n_{r.kind}" for i, r in enumerate(RULES) if r.base)
    + ", list_sort("
    + "list_concat("
    + ", ".join(f"s{i}" for i in range(len(RULES)))
    + ")) AS f FROM s), l AS (SELECT *, list_transform(f, lambda m: {'no': m['no'], 'line': ["
    + ", ".join(f"'{r.kind}'" for r in RULES)
    + "][m['no'] + 1] || ':' || m['start'] || ':' || (m['start'] + m['long'])}) AS x FROM a) SELECT doc_id, "
    + ", ".join(f"n_{r.kind}" for r in RULES if r.base)
    + f", sha256(array_to_string(list_transform(list_filter(x, lambda m: m['no'] < {sum(r.base for r in RULES)}), lambda m: m['line']), ',')) AS base_sha256, "
    + "array_to_string(list_transform(x, lambda m: m['line']), ',') AS spans FROM l"
)
