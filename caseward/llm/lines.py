"""Operator 3: line dedup with a suffix array over line-ID sequences.

A line's ID is its 128-bit hash.  Lines without a word are left out of the
sequences and always stay.  Suffixes start at every line; they are ranked by their
first line, then by two, four, ... lines: the rank of a longer prefix is the order
of the pair (rank here, rank further on).  Suffixes of one rank are an interval of
the suffix array whose longest common prefix has at least that many lines: a
repeated run.  Its first copy stays, later ones go.

A line goes when it lies in a later copy of a run of ``min_lines`` lines, or is
itself a later copy and has ``min_words`` words.  Every longer maximal run is the
union of its windows of ``min_lines`` lines, each a later copy too, so ranks deeper
than that delete nothing else and doubling ends there.  Copies are ordered by
(doc_id, hash of the text, line); a run may overlap its copy.

Scale: all steps are DataFrame operations.  Only lines that occur twice take part
after the first grouping; ranks come from a range sort of distinct keys, not of
copies; groupings combine on the map side and the joins back to the copies may be
split by adaptive execution, so a line in a third of all documents is no hot key.
The text is shuffled once, to be cut.

Defined results: a null text stays null, an empty one empty; a null doc_id comes
first; rows equal in doc_id and text are one document and get equal results; texts
are used whole; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.sources.shared import Stored, stored

MIN_LINES = 2
MIN_WORDS = 8
_WORD = r"[^\\x20\\x09-\\x0D]"
_NULL_ID = -(1 << 63)
_DOC = ["k", "t"]
#: A copy's place in the order of copies.
_AT = "struct(k, t, seq)"


def _keyed(documents: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))
    return documents.withColumns({"k": key, "t": F.xxhash64("text")})


def _lines(documents: DataFrame, min_words: int) -> DataFrame:
    """(k, t, seq, i, h1, h2, long): the seq-th line with a word is line i of its text."""
    numbered = F.expr(f"filter(transform(split(text, '\\n', -1), (x, i) -> struct(i, x)), s -> s.x RLIKE '{_WORD}')")
    rows = _keyed(documents.select("doc_id", "text")).select(*_DOC, F.posexplode(numbered).alias("seq", "line"))
    words = F.expr(f"regexp_count(line.x, '{_WORD}+')")
    hashes = [F.xxhash64("line.x").alias("h1"), F.xxhash64(F.lit(1), "line.x").alias("h2")]
    return rows.select(*_DOC, "seq", F.col("line.i").alias("i"), *hashes, (words >= min_words).alias("long"))


def _intervals(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, first) of every key that occurs twice; ranks follow the order of the keys."""
    groups = suffixes.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.expr(_AT)).alias("first")).filter("n > 1").drop("n")
    ordered = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def later_copies(documents: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, t, i) of the lines to delete, repeats possible."""
    lines = stored(_lines(documents, min_words), "lines")
    ranks = _intervals(lines, ["h1", "h2"])
    now = lines.join(ranks, ["h1", "h2"]).select(*_DOC, "seq", F.array("i").alias("lines"), "rank", "first", "long")
    # Equal rows are one document: without their repeats the joins along a text stay one to one.
    suffixes = stored(now.dropDuplicates([*_DOC, "seq"]), "suffixes")
    gone = suffixes.filter(F.col("long") & F.expr(f"{_AT} > first")).select(*_DOC, F.explode("lines").alias("i"))
    width = 1
    while width < min_lines:
        step = min(width, min_lines - width)
        ahead = suffixes.select(*_DOC, (F.col("seq") - step).alias("seq"), F.col("rank").alias("then"), F.slice("lines", width - step + 1, step).alias("more"))
        pairs = Stored(suffixes.select(*_DOC, "seq", "lines", F.col("rank").alias("here")).join(ahead, [*_DOC, "seq"]), "pairs")
        ranks = _intervals(pairs.read(), ["here", "then"])
        joined = pairs.read().join(ranks, ["here", "then"])
        suffixes = stored(joined.select(*_DOC, "seq", F.concat("lines", "more").alias("lines"), "rank", "first"), "suffixes")
        pairs.drop()
        width += step
    return gone.unionByName(suffixes.filter(f"{_AT} > first").select(*_DOC, F.explode("lines").alias("i")))


def dedupe(documents: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_deleted, kept_text of each row, then the columns named in ``keep``."""
    gone = later_copies(documents, min_lines, min_words).groupBy(*_DOC).agg(F.collect_set("i").alias("gone"))
    given = documents.select("doc_id", "text", *[F.col(c).alias(f"_{c}") for c in keep])
    rows = _keyed(given).join(gone, _DOC, "left").withColumn("lines", F.split("text", "\n", -1))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    sizes = [F.coalesce(F.size(c), F.lit(0)).cast("long").alias(n) for c, n in (("lines", "n_lines"), ("gone", "n_deleted"))]
    sizes = [F.greatest(s, F.lit(0).cast("long")).alias(n) for s, n in zip(sizes, ("n_lines", "n_deleted"), strict=True)]
    return rows.select("doc_id", *sizes, text.alias("kept_text"), *[f"_{c}" for c in keep])


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents with their columns and what is left of their texts.

    Documents that had nothing but later copies go.  ``n_chars`` follows the text.
    """
    columns = documents.columns
    rows = dedupe(documents, keep=tuple(columns))
    rows = rows.filter((F.col("n_deleted") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(dict(documents.dtypes).get("n_chars", "long"))}
    return rows.select(*[changed.get(c, F.col(f"_{c}")).alias(c) for c in columns])


SQL = rf"""
WITH line AS (
    SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq
    FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
    WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), run AS (
    SELECT doc_id, i, seq, x, lead(x) OVER w AS y, lead(i) OVER w AS j FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY seq)
), marked AS (
    SELECT doc_id, i, j, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= {MIN_WORDS} AND row_number() OVER (PARTITION BY x ORDER BY doc_id, seq) > 1 AS alone,
        y IS NOT NULL AND row_number() OVER (PARTITION BY x, y ORDER BY doc_id, seq) > 1 AS pair
    FROM run
), gone AS (
    SELECT doc_id, i FROM marked WHERE alone OR pair UNION SELECT doc_id, j FROM marked WHERE pair
), kept AS (
    SELECT l.doc_id, count(g.i) AS n_deleted, count(*) AS n_lines, string_agg(CASE WHEN g.i IS NULL THEN l.x END, chr(10) ORDER BY l.i) AS kept_text
    FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) l
    LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i
    GROUP BY l.doc_id
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_deleted AS BIGINT) AS n_deleted, sha256(coalesce(kept_text, '')) AS kept_sha256 FROM kept
"""
