"""Readers of the native text formats, to the canonical schemas. gzip files are read as they are; filters stand before the unpivot."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.functions import expr

#: Fixed column names by role, tried in this order, in any case.
ALIASES = {
    "chrom": ("chrom", "chromosome", "chr", "contig"),
    "start": ("start", "win_start", "window_start", "start_bp"),
    "end": ("end", "win_end", "window_end", "end_bp"),
    "n_variants": ("n_variants", "n_sites", "n_snps"),
    "candidate_id": ("candidate_id", "interval_id", "parent_id", "id"),
    "stat": ("fst", "hudson_fst", "fst_mean", "pi", "theta_pi", "theta_pi_all", "dxy", "da", "tajima_d", "tajimad", "fdm", "xpehh_mean", "ihs_mean"),
}
STAT_PREFIXES = ("fst_", "pi_", "dxy_", "da_", "fdm_")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Value, _file and line: the place of a line in its file. Lines are numbered within the splits of a file, in their order; counts
    of splits (a row each) are carried forward by their first byte, so that no task sees a whole file and numbers don't depend on how
    splits were dealt."""
    t = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_m"))
    own = F.row_number().over(Window.partitionBy("_file", "_at").orderBy("_m")) - 1
    before = t.groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("_n")).select("_file", "_at", F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return t.withColumn("_o", own).join(F.broadcast(before), ["_file", "_at"]).select("value", "_file", (F.col("_o") + F.col("_b")).alias("line"))


def _marker(m: Column) -> tuple[Column, Column]:
    """Chromosome and position of chrom_pos, split at the last underscore."""
    return F.regexp_extract(m, r"^(.*)_[^_]*$", 1), F.regexp_extract(m, r"_([^_]*)$", 1).try_cast("long")


def allele(code: Column) -> Column:
    """Letters of the codes 0..3; letters stay."""
    return F.when(code.isin("0", "1", "2", "3"), F.element_at(F.array(*map(F.lit, "ACGT")), code.try_cast("int") + 1)).otherwise(F.upper(code))


def header_samples(header: list[str]) -> list[str]:
    """Sample names of a likelihood file: three columns each; a suffix after the last underscore goes where all three agree without it."""
    names = []
    for i in range(3, len(header) - 2, 3):
        trio = header[i : i + 3]
        stems = {re.sub(r"_[^_]*$", "", x) for x in trio}
        names.append(stems.pop() if len(stems) == 1 and len(set(trio)) == 3 else trio[0])
    return names


def beagle(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None, floor: float | None = None, normalise: bool = False, kind: str = "double") -> DataFrame:
    """site_idx (of the file, before all filters), chrom, pos, allele1, allele2, sample_idx, sample_id, gl0, gl1, gl2."""
    t = lines(spark, path)
    names = header_samples(re.split(r"\t", t.filter("line = 0").first()["value"]))
    f = F.split("value", "\t")
    c, p = _marker(f[0])
    sites = t.filter("line > 0").select((F.col("line") - 1).alias("site_idx"), c.alias("chrom"), p.alias("pos"), allele(f[1]).alias("allele1"), allele(f[2]).alias("allele2"), F.slice(f, 4, F.greatest(F.size(f) - 3, F.lit(0))).alias("_g"))
    if chrom is not None:
        sites = sites.filter(F.col("chrom") == chrom)
    if start is not None:
        sites = sites.filter(F.col("pos") >= start)
    if end is not None:
        sites = sites.filter(F.col("pos") <= end)
    each = sites.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.size("_g") / 3).cast("int") - 1)).alias("sample_idx"))
    g = [F.get("_g", F.col("sample_idx") * 3 + k).try_cast("double") for k in range(3)]
    if floor is not None:
        g = [F.greatest(x, F.lit(floor)) for x in g]
    if normalise:
        total = g[0] + g[1] + g[2]
        g = [F.when(total > 1e-15, x / total).otherwise(x) for x in g]
    ids = F.get(F.array(*[F.lit(n) for n in names]), F.col("sample_idx")) if names else F.lit(None).cast("string")
    return each.select("site_idx", "chrom", "pos", "allele1", "allele2", "sample_idx", ids.alias("sample_id"), *[x.cast(kind).alias(f"gl{k}") for k, x in enumerate(g)])


def beagle_markers(spark: SparkSession, path: str) -> DataFrame:
    """Chrom and pos alone."""
    c, p = _marker(F.substring_index("value", "\t", 1))
    return lines(spark, path).filter("line > 0").select(c.alias("chrom"), p.alias("pos"))


def matrix(spark: SparkSession, path: str, index: str, name: str) -> DataFrame:
    """Rows of numbers parted by white space, with their place. A file with a header of a local cache is refused."""
    t = lines(spark, path)
    first = t.filter("line = 0").first()
    if first and re.search(r"\b(Q1|window|window_id|sample|sample_id)\b", first["value"]):
        raise ValueError(f"{path} has a header: it is a local table, not a matrix")
    v = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return t.filter(F.trim("value") != "").select(F.col("line").alias(index), F.transform(v, lambda x: x.try_cast("double")).alias(name))


def tsv(spark: SparkSession, path: str, header: bool = True, names: list[str] | None = None) -> DataFrame:
    """A table of strings: # and blank lines skipped, rows with another number of fields dropped; `tsv_dropped` counts those."""
    t = lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("_k", F.row_number().over(Window.partitionBy("_file").orderBy("line")))
    if header:
        names = t.filter("_k = 1").first()["value"].split("\t")
        t = t.filter("_k > 1")
    f = F.split("value", "\t", -1)
    return t.filter(F.size(f) == len(names)).select(*[f[i].alias(n) for i, n in enumerate(names)])


def tsv_dropped(spark: SparkSession, path: str) -> int:
    t = lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    n = t.orderBy("line").first()
    want = len(n["value"].split("\t")) if n else 0
    return t.filter(F.size(F.split("value", "\t", -1)) != want).count()


def metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """key=value pairs of the # lines."""
    rows = lines(spark, path).filter(F.col("value").startswith("#")).orderBy("line").limit(100).collect()
    return {k: v for r in rows for k, v in re.findall(r"(\S+?)=(\S+)", r["value"].lstrip("# "))}


def resolve(columns: list[str], role: str) -> str | None:
    """The column that plays a role, by its aliases in any case."""
    low = {c.lower(): c for c in reversed(columns)}
    for a in ALIASES[role]:
        if a in low:
            return low[a]
    if role == "stat":
        return next((c for c in columns if c.lower().startswith(STAT_PREFIXES)), None)
    return None


def track(spark: SparkSession, path: str, stat: str | None = None) -> DataFrame:
    """A track with chrom, start, end, stat, n_variants, columns found by alias; missing and infinite values null."""
    t = tsv(spark, path)
    names = {role: resolve(t.columns, role) for role in ("chrom", "start", "end", "n_variants")} | {"stat": stat or resolve(t.columns, "stat")}
    lost = [r for r in ("chrom", "start", "end", "stat") if names[r] is None]
    if lost:
        raise ValueError(f"no column for {', '.join(lost)} in {t.columns}")
    n = F.col(names["n_variants"]).try_cast("long") if names["n_variants"] else F.lit(None).cast("long")
    return t.select(F.col(names["chrom"]).alias("chrom"), F.col(names["start"]).try_cast("long").alias("start"), F.col(names["end"]).try_cast("long").alias("end"), expr.number(F.col(names["stat"])).alias("stat"), n.alias("n_variants"))


def bed(spark: SparkSession, path: str, prefix: str = "w") -> DataFrame:
    """Chrom, start, end, id (prefix and place where there is none); lines whose start is no number are headers."""
    f = F.split("value", r"\t")
    t = lines(spark, path).filter(~F.col("value").startswith("#")).select("line", "_file", f[0].alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"), F.get(f, F.lit(3)).alias("id")).filter("start is not null and end is not null")
    k = F.row_number().over(Window.partitionBy("_file").orderBy("line"))
    return t.select("chrom", "start", "end", F.coalesce("id", F.concat(F.lit(prefix), k.cast("string"))).alias("id"))


def genes(spark: SparkSession, path: str) -> DataFrame:
    """Chrom, start, end, gene_id, ord."""
    return bed(spark, path, "gene").withColumnRenamed("id", "gene_id").withColumn("ord", F.monotonically_increasing_id())


def hwe(spark: SparkSession, path: str) -> DataFrame:
    """HWE sites of 9 or 10 columns: chrom, pos, freq, f."""
    f = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).filter("line > 0").filter(F.size(f).isin(9, 10)).select(f[0].alias("chrom"), f[1].try_cast("long").alias("pos"), expr.number(f[4]).alias("freq"), expr.number(f[6]).alias("f")).filter("pos is not null")


def sample_list(spark: SparkSession, path: str) -> DataFrame:
    """sample_idx and sample_id."""
    return lines(spark, path).filter(F.trim("value") != "").select(F.col("line").cast("int").alias("sample_idx"), expr.sample_id(F.trim("value")).alias("sample_id"))


def groups(spark: SparkSession, spec: str, samples: DataFrame) -> DataFrame:
    """Group and sample_idx, from name:file,... or from one file of sample TAB group. Unknown samples are left out."""
    if ":" in spec and "://" not in spec:
        found = None
        for part in spec.split(","):
            name, _, path = part.partition(":")
            one = sample_list(spark, path).select(F.lit(name).alias("group"), "sample_id")
            found = one if found is None else found.unionByName(one)
    else:
        f = F.split("value", "\t")
        found = lines(spark, spec).filter(F.size(f) >= 2).select(f[1].alias("group"), expr.sample_id(f[0]).alias("sample_id"))
    return found.join(samples.select("sample_id", "sample_idx"), "sample_id").select("group", "sample_idx").distinct()


def karyotypes(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    return lines(spark, path).select(expr.sample_id(f[0]).alias("sample_id"), expr.karyotype_state(F.get(f, F.lit(1))).alias("state")).filter("state is not null")


#: Lines of a sequence that are joined to one piece at most.
LINES = 10_000


def _records(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Lines of splits in order to pieces of records: split, number of the record's header within it (0: a record begun before), place of the
    piece, and a header or the joined letters of at most `most` lines without white space."""
    key, n, at = None, 0, 0
    for batch in batches:
        head = pc.starts_with(batch.column("value"), ">").to_numpy(zero_copy_only=False)
        lines, bare = batch.column("value"), pc.replace_substring_regex(batch.column("value"), r"[ \t\n\x0b\f\r]", "").to_pylist()
        files, starts = batch.column("_file").dictionary_encode(), batch.column("_at").to_numpy()
        code = files.indices.to_numpy()
        new = np.ones(len(head), bool)
        new[1:] = (code[1:] != code[:-1]) | (starts[1:] != starts[:-1])
        new[1:] |= head[:-1]
        cuts = [*np.flatnonzero(new | head | (np.arange(len(head)) % most == 0)).tolist(), len(head)]
        out: list[tuple] = []
        for i, j in zip(cuts, cuts[1:]):
            here = (files.dictionary[int(code[i])].as_py(), int(starts[i]))
            if here != key:
                key, n, at = here, 0, 0
            n += int(head[i])
            out.append((*key, n, at, lines[i].as_py() if head[i] else None, None if head[i] else "".join(bare[i:j])))
            at += 1
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["_file", "_at", "_r", "_o", "_n", "_s"])


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Ord, name (to the first blank), seq (white space removed). A record begins at a line that starts with >; others may hold it. Its lines
    may lie in several splits: they are joined to pieces as they are read, headers are counted by splits and the counts carried (a row each).
    ord rises with the files' paths and the records' places; lines before a file's first header are left out. A sequence must fit a row."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    sums = t.groupBy("_file", "_at").agg(F.sum(F.col("value").startswith(">").cast("int")).alias("_s"))
    w = Window.partitionBy("_file")
    before = sums.select("_file", "_at", F.coalesce(F.sum("_s").over(w.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    files = sums.groupBy("_file").agg(F.sum("_s").alias("_s")).select("_file", F.coalesce(F.sum("_s").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_f"))  # a row for each file
    most = LINES
    pieces = t.mapInArrow(lambda b: _records(b, most), "_file string, _at long, _r long, _o long, _n string, _s string")
    numbered = pieces.join(F.broadcast(before), ["_file", "_at"]).withColumn("_r", F.col("_r") + F.col("_b")).filter("_r > 0").join(F.broadcast(files), "_file")
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct("_at", "_o", "_s")))), lambda x: x["_s"])
    got = numbered.select((F.col("_f") + F.col("_r") - 1).alias("ord"), "_at", "_o", "_n", "_s").groupBy("ord").agg(F.max("_n").alias("_n"), parts.alias("_p"))
    return got.select("ord", F.regexp_extract(F.expr("substring(_n, 2)"), r"^(\S*)", 1).alias("name"), F.array_join("_p", "").alias("seq"))


def fasta_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Neighbouring records as pairs; unequal lengths and a last odd record are left out. The id loses _A, _B, _1 or _2."""
    t = fasta(spark, path).withColumnRenamed("ord", "_k")
    two = t.groupBy(F.floor(F.col("_k") / 2).alias("_pair")).agg(*[F.max(F.when(F.col("_k") % 2 == i, F.col(c))).alias(f"{c}_{i}") for c, i in (("name", 0), ("seq", 0), ("seq", 1))])
    return two.filter("seq_1 is not null and length(seq_0) = length(seq_1)").select(F.regexp_replace("name_0", "_[AB12]$", "").alias("pair_id"), F.col("seq_0").alias("seq_a"), F.col("seq_1").alias("seq_b"))


def cds_pairs(spark: SparkSession, path: str) -> DataFrame:
    """S20."""
    return tsv(spark, path, False, ["pair_id", "seq_a", "seq_b"]).filter("pair_id <> 'pair_id' and length(seq_a) = length(seq_b)")


HIT = ("query", "target", "source_type", "identity", "bitscore", "evalue", "q_start", "q_end", "t_start", "t_end", "aln_len", "strand", "n_segments", "hit_id")


def diamond(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a protein aligner in 12 fields."""
    f = F.split("value", "\t")
    n = lambda i, t="double": f[i].try_cast(t)
    cols = (f[0], f[1], F.lit("diamond"), n(2) / 100, n(11), n(10), n(6, "long"), n(7, "long"), n(8, "long"), n(9, "long"), n(3, "long"), F.lit("0"), F.lit(1), F.concat_ws(":", F.element_at(F.split("_file", "/"), -1), "line"))
    return lines(spark, path).filter(F.size(f) >= 12).select(*[c.alias(k) for c, k in zip(cols, HIT, strict=True)])


def paf(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a genome aligner: 12 fields and tags; identity is matches by length, the score a ms or AS tag or else -1."""
    f = F.split("value", "\t")
    n = lambda i: f[i].try_cast("long")
    tag = lambda k: F.nullif(F.regexp_extract("value", rf"\t{k}:i:(-?\d+)", 1), F.lit("")).try_cast("double")
    cols = (f[0], f[5], F.lit("miniprot"), n(9) / F.nullif(n(10), F.lit(0)), F.coalesce(tag("ms"), tag("AS"), F.lit(-1.0)), F.lit(-1.0), n(2), n(3), n(7), n(8), n(10), f[4], F.lit(1), F.concat_ws(":", F.element_at(F.split("_file", "/"), -1), "line"))
    return lines(spark, path).filter(~F.col("value").startswith("#") & (F.size(f) >= 12)).select(*[c.alias(k) for c, k in zip(cols, HIT, strict=True)])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """All hits of a manifest of type, path, label."""
    rows = tsv(spark, path, False, ["type", "path", "label"]).collect()  # a few files
    out = None
    for r in rows:
        one = (diamond if r["type"] == "diamond" else paf)(spark, r["path"]).withColumn("label", F.lit(r["label"]))
        out = one if out is None else out.unionByName(one)
    return out


def wide(spark: SparkSession, path: str, part: str, row: str, column: str, value: str) -> DataFrame:
    """Matrices of text (a folder part=... for each, a header of names) as a long table of strings part, row, column, value. The headers, one
    line a file, are broadcast."""
    f = F.split("value", "\t")
    t = lines(spark, path).withColumn("_part", F.regexp_extract("_file", rf"/{re.escape(part)}=([^/]+)/", 1))
    heads = t.filter("line = 0").select("_file", F.slice(f, 2, F.size(f) - 1).alias("_names"))
    cells = F.explode(F.arrays_zip(F.col("_names").alias("n"), F.slice(f, 2, F.size(f) - 1).alias("c")))
    long = t.filter("line > 0").join(F.broadcast(heads), "_file").select("_part", f[0].alias("_row"), cells.alias("_x"))
    return long.select(F.col("_part").alias(part), F.col("_row").alias(row), F.col("_x.n").alias(column), F.col("_x.c").alias(value))


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """S25."""
    f = F.split("value", "\t")
    return lines(spark, path).filter(F.size(f) >= 2).select(f[0].alias("chrom"), f[1].try_cast("long").alias("length"))


def covariances(spark: SparkSession, path: str) -> DataFrame:
    """.cov files below a folder with the chromosome in their path."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cov").load(path).select("path", "length")
    return t.select("path", "length", F.regexp_extract("path", r"(chr[^/._]+|LG\d+)", 1).alias("chrom"))


def shell_config(text: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """Export K=V lines, ${V} expanded from earlier lines and env."""
    out = dict(env or {})
    for k, v in re.findall(r"^\s*(?:export\s+)?(\w+)=(.*)$", text, re.M):
        v = v.strip().strip("\"'")
        out[k] = re.sub(r"\$\{(\w+)(?::-([^}]*))?\}|\$(\w+)", lambda m: out.get(m[1] or m[3], m[2] or ""), v)
    return out
