"""Reads and alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotables.catalog.registry import Tables, query
from biotables.operators import reads
from biotables.operators.intervals import overlaps
from biotables.session import scratch_path
from biotables.sources import text


READ = 150
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASES = "ACGTACGTACGTACGTACGTACGTAC"


def mate(t: Tables, number: int):
    """Reads of :func:`marked`, without the letters of their qualities."""
    return marked(t, number).drop("marks")


def marked(t: Tables, number: int):
    """The letters a to z of every whole text as reads of at most 150 bases; the second mate is read backwards."""
    letters = F.regexp_replace("text", "[^a-z]", "")
    letters = F.reverse(letters) if number == 2 else letters
    whole = t.documents.select("doc_id", letters.alias("letters"))
    reads_ = whole.select(
        "doc_id", F.posexplode(F.expr(f"transform(sequence(0, int(greatest(length(letters) - 1, 0) div {READ})), k -> substr(letters, k * {READ} + 1, {READ}))")).alias("k", "part")
    )
    quality = F.transform(F.filter(F.split("part", ""), lambda c: c != ""), lambda c: (F.ascii(c) * (5 + 2 * number)) % 41)
    return reads_.select(
        F.concat_ws(":", "doc_id", "k").alias("read_id"),
        F.lit(number).alias("mate"),
        F.translate("part", _LETTERS, _BASES).alias("bases"),
        quality.alias("quality"),
        # the same qualities as the letters of a FASTQ file
        F.translate("part", _LETTERS, "".join(chr(33 + ord(c) * (5 + 2 * number) % 41) for c in _LETTERS)).alias("marks"),
    )


def _mate_sql(number: int) -> str:
    letters = "regexp_replace(text, '[^a-z]', '', 'g')"
    letters = f"reverse({letters})" if number == 2 else letters
    return f"""SELECT doc_id || ':' || k AS read_id, {number}::INT AS mate, translate(part, '{_LETTERS}', '{_BASES}') AS bases,
 list_transform(list_filter(string_split(part, ''), lambda c: c <> ''), lambda c: ((ord(c) * {5 + 2 * number}) % 41)::INT) AS quality
 FROM (SELECT doc_id, k, substr(letters, k * {READ} + 1, {READ}) AS part FROM (SELECT doc_id, letters,
 unnest(range(greatest(length(letters) - 1, 0) // {READ} + 1)) AS k FROM (SELECT doc_id, {letters} AS letters FROM documents)))"""


_ALIGN = """alignments AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey AS read_id, l_suppkey AS contig,
 date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS start, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)
 + l_quantity::BIGINT AS stop FROM lineitem)"""
_LONG = """features AS (SELECT 'kind' || (p_size % 10) AS kind, p_partkey % 10 AS contig, p_size::BIGINT * 41 % 2300 AS start,
 p_size::BIGINT * 41 % 2300 + pow(10, p_size % 10)::BIGINT AS stop FROM part)"""
_MATES = f"m1 AS MATERIALIZED ({_mate_sql(1)}), m2 AS MATERIALIZED ({_mate_sql(2)})"


def _write_fastq(rows, folder: str) -> None:
    record = F.concat(F.lit("@"), "read_id", F.lit(" of a text\n"), "bases", F.lit("\n+\n"), "marks")
    rows.select(record.alias("value")).write.text(folder)


@query(f"""WITH {_MATES} SELECT 'L001' AS lane, read_id, mate, bases, list_sum(quality)::BIGINT AS quality_sum FROM m1
 UNION ALL SELECT 'L002', read_id, mate, bases, list_sum(quality)::BIGINT FROM m2""")
def reads_concat(t: Tables):
    """FASTQ files of two lanes, written, then read in one pass with lane and mate from the file name."""
    folder = scratch_path(t.spark, "lanes")
    for number in (1, 2):
        rows = marked(t, number)
        _write_fastq(rows, f"{folder}/S1_L00{number}_R{number}")
    both = reads.concat_lanes(text.read_fastq(t.spark, [f"{folder}/S1_L00{n}_R{n}" for n in (1, 2)]))
    total = F.aggregate("quality", F.lit(0).cast("bigint"), lambda a, q: a + q)
    return both.select("lane", "read_id", "mate", "bases", F.when(F.size("quality") > 0, total).alias("quality_sum"))


@query(f"""WITH {_MATES} SELECT 'fastq' AS kind, read_id, bases, list_sum(quality)::BIGINT AS quality_sum FROM m1
 UNION ALL SELECT 'fasta', read_id, bases, NULL FROM m2""")
def fastq_split_reads(t: Tables):
    """FASTQ and FASTA files read in ranges of 4 KB, so that nearly every range begins within a record."""
    folder = scratch_path(t.spark, "split-reads")
    _write_fastq(marked(t, 1), f"{folder}/fastq")
    wrapped = F.concat(F.lit(">"), "read_id", F.lit(" mate\n"), F.substring("bases", 1, 70), F.lit("\n"), F.substring("bases", 71, READ))
    mate(t, 2).select(wrapped.alias("value")).write.text(f"{folder}/fasta")
    total = F.when(F.size("quality") > 0, F.aggregate("quality", F.lit(0).cast("bigint"), lambda a, q: a + q))
    fastq = text.read_fastq(t.spark, f"{folder}/fastq", range_bytes=4096)
    fasta = text.read_fasta(t.spark, f"{folder}/fasta", range_bytes=4096)
    return fastq.select(F.lit("fastq").alias("kind"), "read_id", "bases", total.alias("quality_sum")).unionByName(
        fasta.select(F.lit("fasta").alias("kind"), F.col("seq_id").alias("read_id"), F.col("sequence").alias("bases"), F.lit(None).cast("bigint").alias("quality_sum"))
    )


@query(f"""WITH {_ALIGN}, {_LONG} SELECT kind, COUNT(*) AS n_pairs, SUM(least(a.stop, f.stop) - greatest(a.start, f.start))::BIGINT AS shared
 FROM alignments a JOIN features f ON f.contig = a.contig AND f.start < a.stop AND f.stop > a.start GROUP BY 1""")
def interval_overlaps(t: Tables):
    """Pairs of alignments and features that share positions, features from one base to whole chromosomes."""
    features = t.part.select(
        F.concat(F.lit("kind"), F.col("p_size") % 10).alias("kind"), (F.col("p_partkey") % 10).alias("contig"),
        (F.col("p_size").cast("bigint") * 41 % 2300).alias("f_start"),
        (F.col("p_size").cast("bigint") * 41 % 2300 + F.pow(F.lit(10), F.col("p_size") % 10).cast("bigint")).alias("f_end"),
    )
    pairs = overlaps(alignments(t), features, "contig", ("start", "end"), ("f_start", "f_end"))
    shared = F.least("end", "f_end") - F.greatest("start", "f_start")
    return pairs.groupBy("kind").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(shared).alias("shared"))


@query(f"""WITH {_MATES}, n2 AS (SELECT m2.* FROM m2 JOIN documents ON doc_id = split_part(read_id, ':', 1)::BIGINT WHERE lang <> 'fr')
 SELECT read_id, mate, bases FROM m1 WHERE read_id IN (SELECT read_id FROM n2) UNION ALL SELECT read_id, mate, bases FROM n2""")
def reads_interleave(t: Tables):
    """Mates side by side; a read without its partner is left out (French texts have no second mate here)."""
    spoken = t.documents.filter(F.col("lang") != "fr").select("doc_id")
    reverse = mate(t, 2).withColumn("doc_id", F.substring_index("read_id", ":", 1).cast("bigint"))
    reverse = reverse.join(spoken, "doc_id", "left_semi").drop("doc_id")
    return reads.interleave(mate(t, 1), reverse).select("read_id", "mate", "bases")


@query(f"""WITH {_MATES}, c AS (SELECT mate, unnest(range(1, length(bases) + 1)) AS cycle, unnest(quality) AS q, unnest(list_filter(string_split(bases, ''), lambda c: c <> '')) AS base
 FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2))
 SELECT mate, cycle::INT AS cycle, COUNT(*) AS n_reads, round(AVG(q), 6) AS mean_quality, MIN(q) AS min_quality,
 MAX(q) AS max_quality, round(AVG((base IN ('G', 'C'))::INT), 6) AS gc FROM c GROUP BY 1, 2""")
def reads_quality_profile(t: Tables):
    """Quality and GC per mate and cycle."""
    out = reads.quality_profile(mate(t, 1).unionByName(mate(t, 2)))
    return out.withColumn("mean_quality", F.round("mean_quality", 6)).withColumn("gc", F.round("gc", 6))


@query("""SELECT length(text)::INT AS length, COUNT(*) AS n_reads, round(AVG(length(regexp_replace(text, '[^GC]', '', 'g'))::DOUBLE
 / nullif(length(text), 0)), 6) AS gc FROM documents GROUP BY 1""")
def reads_length_profile(t: Tables):
    """Length and GC profile over whole texts."""
    out = reads.length_profile(t.documents.select(F.col("text").alias("bases")))
    return out.withColumn("gc", F.round("gc", 6))


@query(f"""WITH {_MATES}, r AS (SELECT *, len(quality) AS n FROM m1 UNION ALL SELECT *, len(quality) FROM m2),
 a AS (SELECT *, coalesce(list_min(list_filter(range(0, n), lambda i: quality[i + 1] >= 3)), n) AS s,
 coalesce(list_max(list_filter(range(0, n), lambda i: quality[i + 1] >= 3)) + 1, 0) AS e FROM r),
 k AS (SELECT read_id, mate, bases, s, coalesce(list_min(list_filter(range(0, n), lambda i: i >= s AND i + 4 <= greatest(e, s)
 AND quality[i + 1] + quality[i + 2] + quality[i + 3] + quality[i + 4] < 60)), greatest(e, s)) - s AS len FROM a)
 SELECT read_id, mate, substr(bases, s + 1, len) AS bases, CASE WHEN COUNT(*) OVER (PARTITION BY read_id) = 2 THEN 'paired'
 ELSE 'unpaired' END AS status FROM k WHERE len >= 36""")
def reads_trim(t: Tables):
    """Quality trimming of both mates and the fate of the pair."""
    both = mate(t, 1).unionByName(mate(t, 2))
    return reads.trim_reads(both).select("read_id", "mate", "bases", "status")


@query("""SELECT 'gene' || p_partkey AS feature, 'c' || (p_partkey % 7) AS contig, p_size * 60::BIGINT AS start,
 p_size * 60 + 30::BIGINT AS "end", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part WHERE p_size <= 40""")
def gtf_features(t: Tables):
    """Annotation file to features of one type with an id attribute."""
    kind = F.when(F.col("p_size") <= 40, "CDS").otherwise("tRNA")
    strand = F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-")
    attributes = F.concat(F.lit('transcript_id "t'), "p_partkey", F.lit('"; gene_id "gene'), "p_partkey", F.lit('"'))
    line = F.concat_ws(
        "\t", F.concat(F.lit("c"), F.col("p_partkey") % 7), F.lit("caller"), kind, F.col("p_size") * 60 + 1, F.col("p_size") * 60 + 30,
        F.lit("."), strand, F.lit("0"), attributes,
    )
    path = scratch_path(t.spark, "gtf")
    t.part.select(line.alias("value")).write.text(path)
    return text.read_features(t.spark, path)


# ---------------------------------------------------------------- alignments


def alignments(t: Tables):
    """One alignment per line item: contig = supplier, start = day, length = quantity."""
    start = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("bigint")
    return t.lineitem.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("read_id"),
        F.col("l_suppkey").alias("contig"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("bigint")).alias("end"),
    )


def annotation(t: Tables):
    """Features on the contigs, placed by part size."""
    contigs = t.supplier.agg(F.count(F.lit(1))).scalar()
    start = F.col("p_size").cast("bigint") * 60
    return t.part.select(
        F.concat(F.lit("gene"), F.col("p_partkey")).alias("feature"),
        (F.col("p_partkey") % contigs).alias("contig"),
        start.alias("start"),
        (start + 30 + F.length("p_name")).alias("end"),
    )


_FEATURES = """features AS (SELECT 'gene' || p_partkey AS feature, p_partkey % (SELECT COUNT(*) FROM supplier) AS contig,
 p_size * 60 AS start, p_size * 60 + 30 + length(p_name) AS stop FROM part)"""


@query(f'WITH {_ALIGN} SELECT read_id, contig, start, stop AS "end" FROM alignments')
def alignments_sorted(t: Tables):
    """Range-partitioned coordinate order."""
    return reads.coordinate_sort(alignments(t))


@query(f"""WITH {_ALIGN}, depth AS (SELECT contig, pos, COUNT(*) AS d FROM (SELECT contig, unnest(range(start, stop)) AS pos
 FROM alignments) GROUP BY 1, 2), sums AS (SELECT contig, SUM(d)::DOUBLE AS s1, SUM(d * d)::DOUBLE AS s2 FROM depth GROUP BY 1)
 SELECT s_suppkey AS contig, 4000::BIGINT AS length, round(coalesce(s1, 0) / 4000, 6) AS mean_depth,
 round(coalesce(s2, 0) / 4000 - (coalesce(s1, 0) / 4000) * (coalesce(s1, 0) / 4000), 6) AS var_depth
 FROM supplier LEFT JOIN sums ON contig = s_suppkey""")
def contig_depth(t: Tables):
    """Mean and variance of the depth per contig."""
    contigs = t.supplier.select(F.col("s_suppkey").alias("contig"), F.lit(4000).cast("bigint").alias("length"))
    out = reads.contig_depth(alignments(t), contigs, bucket=512)
    return out.select(
        "contig", "length", F.round("mean_depth", 6).alias("mean_depth"), F.round("var_depth", 6).alias("var_depth")
    )


@query(f"""WITH {_ALIGN}, {_FEATURES}, r AS (SELECT row_number() OVER () AS id, * FROM alignments),
 hit AS (SELECT r.id, COUNT(DISTINCT feature) AS n, MIN(feature) AS feature FROM r LEFT JOIN features f ON f.contig = r.contig
 AND f.start < r.stop AND f.stop > r.start GROUP BY 1),
 named AS (SELECT CASE n WHEN 0 THEN '__no_feature' WHEN 1 THEN feature ELSE '__ambiguous' END AS locus_tag FROM hit)
 SELECT locus_tag, SUM(n)::BIGINT AS count FROM (SELECT locus_tag, 1 AS n FROM named UNION ALL SELECT feature, 0 FROM features) GROUP BY 1""")
def feature_counts(t: Tables):
    """Reads per feature with the special categories."""
    return reads.feature_counts(alignments(t), annotation(t), bucket=256)
