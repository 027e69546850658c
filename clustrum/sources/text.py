"""Text sources and sinks: lines, FASTA records, cost files, labelled output.

Files are read by splits, so a file may be of any size. Lines are numbered by the splits' counts and their place in the
split; ids follow the order of the files given and of the lines in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.edit import Costs

#: Lines of a chunk: what a task sorts at a time. Only one row a chunk takes part in running sums over a file.
CHUNK = 1 << 16


def numbered(rows: DataFrame, within_file: bool = True) -> DataFrame:
    """Rows (file, start, row, ...) of file splits with their place, `line`, in the file or in all files, from 0. `row`
    grows by one along a split, as monotonically_increasing_id does, since one task reads a split."""
    splits = rows.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("file").orderBy("start") if within_file else Window.orderBy("file", "start")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = splits.select("file", "start", (before - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(at), ["file", "start"]).withColumn("line", F.col("row") + F.col("shift")).drop("start", "row", "shift")


def numbered_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, line, text): lines of the files in order; a last line without a line feed counts. Carriage returns before
    a line feed and blanks at the end of a line are left out."""
    parts = []
    for n, path in enumerate(files):
        rows = spark.read.option("lineSep", "\n").text(path)
        parts.append(rows.select(F.lit(n).alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", " *\\r?$", "").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return numbered(out).select("file", "line", "text")


def is_fasta(lines: DataFrame) -> bool:
    """Whether any line begins with `>`; then all files are FASTA."""
    return lines.where(F.col("text").startswith(">")).limit(1).count() > 0


def _chunks(rows: DataFrame, *sums) -> tuple[DataFrame, DataFrame]:
    """The rows with their chunk, and a table of the given aggregates by (file, chunk)."""
    rows = rows.withColumn("chunk", F.floor(F.col("line") / CHUNK))
    return rows, rows.groupBy("file", "chunk").agg(*sums)


def _ids(rows: DataFrame) -> DataFrame:
    """Ids 0, 1, ... in order of (file, line): offsets of the chunks from their counts, then ranks within a chunk."""
    rows, counts = _chunks(rows, F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("file", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("file", "chunk").orderBy("line")) - 1
    return rows.withColumn("rank", rank).join(starts, ["file", "chunk"]).withColumn("id", (F.col("rank") + F.col("before")).cast("long"))


def sequences(lines: DataFrame) -> DataFrame:
    """(id, s): one sequence a line; blank lines and those beginning with # are skipped; `>` at the start is an error."""
    if is_fasta(lines):
        raise ValueError("a plain sequence file has a line that begins with >")
    kept = lines.where((F.col("text") != "") & ~F.col("text").startswith("#"))
    return _ids(kept).select("id", F.col("text").alias("s"))


def fasta(lines: DataFrame) -> DataFrame:
    """(id, name, s): records of `>name` and content lines, joined and upper-cased.

    Errors: an empty name, a blank or another name right after a name, a blank within content, a space in content, a
    name without content.
    """
    body = lines.where(~F.col("text").startswith("#"))
    flagged, sums = _chunks(body.withColumn("head", F.col("text").startswith(">")), F.sum(F.col("head").cast("int")).alias("heads"), F.max_by("text", "line").alias("last"))
    in_file = Window.partitionBy("file").orderBy("chunk")
    heads = F.coalesce(F.sum("heads").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select("file", "chunk", heads.alias("heads"), F.lag("last").over(in_file).alias("last"))
    in_chunk = Window.partitionBy("file", "chunk").orderBy("line")
    ranked = flagged.withColumn("own", F.sum(F.col("head").cast("int")).over(in_chunk)).withColumn("above", F.lag("text").over(in_chunk))
    numbered = ranked.join(carried, ["file", "chunk"]).withColumn("record", F.col("own") + F.col("heads")).withColumn("before", F.coalesce("above", "last"))
    numbered = numbered.withColumn("head_before", F.coalesce(F.col("before").startswith(">"), F.lit(False)))
    blank = F.col("text") == ""
    # a blank ends a record: content after it within the same record is an error
    within = Window.partitionBy("file", "record").orderBy("line")
    numbered = numbered.withColumn("ended", F.coalesce(F.max((blank & ~F.col("head_before")).cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    problem = (
        F.when(F.trim(F.substring("text", 2, 1 << 20)).eqNullSafe("") & F.col("head"), "an empty name")
        .when(F.col("head") & F.col("head_before"), "a name follows a name")
        .when(blank & F.col("head_before") & (F.col("record") > 0), "a blank line follows a name")
        .when(~F.col("head") & ~blank & (F.col("record") == 0), "content before the first name")
        .when(~F.col("head") & ~blank & F.col("ended"), "a blank line within content")
        .when(~F.col("head") & F.col("text").contains(" "), "a space in content")
    )
    bad = numbered.select("file", "line", problem.alias("problem")).where("problem IS NOT NULL").orderBy("file", "line").limit(1).collect()
    if bad:
        raise ValueError(f"FASTA file {bad[0]['file']}, line {bad[0]['line'] + 1}: {bad[0]['problem']}")
    content = F.array_sort(F.collect_list(F.when(~F.col("head") & ~blank, F.struct("line", "text"))))
    records = numbered.where("record > 0").groupBy("file", "record").agg(
        F.min("line").alias("line"), F.max(F.when(F.col("head"), F.substring("text", 2, 1 << 20))).alias("name"),
        F.upper(F.array_join(F.transform(content, lambda c: c["text"]), "")).alias("s"),
    )
    if records.where("s = ''").limit(1).count():
        raise ValueError("a FASTA record has no content")
    return _ids(records).select("id", "name", "s")


def read_sequences(spark: SparkSession, files: list[str]) -> DataFrame:
    """(id, name, s) of plain or FASTA files; plain sequences have a null name."""
    lines = numbered_lines(spark, files)
    if is_fasta(lines):
        return fasta(lines)
    return sequences(lines).select("id", F.lit(None).cast("string").alias("name"), "s")


def read_costs(spark: SparkSession, path: str) -> Costs:
    """Costs from lines `* v` and `* * v`, or `X v` and `X Y v` (symmetric); # begins a comment."""
    lines = [r["text"] for r in numbered_lines(spark, [path]).orderBy("line").collect()]
    rows = [line.split() for line in lines if line.strip() and not line.lstrip().startswith("#")]
    if len(rows) < 2:
        raise ValueError("a cost file needs an indel and a switch line at least")
    if any(r[0] == "*" for r in rows):
        by_size = {len(r): r for r in rows}
        if len(rows) != 2 or set(by_size) != {2, 3} or any(x != "*" for r in rows for x in r[:-1]):
            raise ValueError("constant costs are one line `* v` and one line `* * v`")
        return Costs(float(by_size[2][1]), float(by_size[3][2]))
    indel: dict[str, float] = {}
    switch: dict[tuple[str, str], float] = {}
    for r in rows:
        if len(r) not in (2, 3) or any(len(x) != 1 for x in r[:-1]):
            raise ValueError(f"not a cost line: {' '.join(r)}")
        if len(r) == 2:
            if r[0] in indel:
                raise ValueError(f"two indel costs of {r[0]}")
            indel[r[0]] = float(r[1])
            continue
        a, b, v = r[0], r[1], float(r[2])
        if a == b:
            raise ValueError(f"a switch of {a} with itself")
        if switch.get((a, b), v) != v:
            raise ValueError(f"contradicting costs of {a} and {b}")
        switch[a, b] = switch[b, a] = v
    return Costs(indel, switch)


def alphabet(sequences: DataFrame) -> DataFrame:
    """(symbol, code): the distinct characters of column s, with codes 0, 1, ... in order."""
    found = sequences.select(F.explode(F.split("s", "")).alias("symbol")).where("symbol <> ''").distinct()
    return found.select("symbol", (F.row_number().over(Window.orderBy("symbol")) - 1).cast("int").alias("code"))


def missing_costs(sequences: DataFrame, costs: Costs) -> list[str]:
    """What the alphabet of the sequences needs and the cost tables lack."""
    if not isinstance(costs.indel, dict):
        return []
    used = sorted(r["symbol"] for r in alphabet(sequences).collect())
    return [f"indel {a}" for a in used if a not in costs.indel] + [f"switch {a} {b}" for i, a in enumerate(used) for b in used[i + 1 :] if (a, b) not in costs.switch]


def recoded(sequences: DataFrame) -> DataFrame:
    """(id, codes): each sequence as the codes of its symbols."""
    table = {r["symbol"]: r["code"] for r in alphabet(sequences).collect()}
    codes = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return sequences.select("id", F.transform(F.filter(F.split("s", ""), lambda c: c != ""), lambda c: F.element_at(codes, c)).alias("codes"))


def write_labelled(labelled: DataFrame, path: str) -> None:
    """Lines `sequence <tab> : label`, or for named records `>name  (label)` and the sequence; in order of id."""
    plain = F.concat("s", F.lit("\t : "), F.col("k").cast("string"))
    named = F.concat(F.lit(">"), "name", F.lit("  ("), F.col("k").cast("string"), F.lit(")\n"), "s")
    labelled.orderBy("id").select(F.when(F.col("name").isNull(), plain).otherwise(named).alias("value")).write.text(path)


def round_log(lines: DataFrame) -> DataFrame:
    """(r, mE, entries): the `key=value` lines of a log that have R and mE; a missing or unreadable number is -1."""
    entries = F.str_to_map(F.regexp_replace(F.trim("text"), r"\s+", " "), F.lit(" "), F.lit("="))
    kept = lines.where(F.col("text").rlike(r"^\s*R=\S+") & F.col("text").contains("mE=")).select(entries.alias("entries"))
    number = lambda k, kind: F.coalesce(F.expr(f"try_cast(entries['{k}'] AS {kind})"), F.lit(-1))
    return kept.select(number("R", "bigint").alias("r"), number("mE", "double").alias("mE"), "entries")
