"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

The index is a table in the shared folder: a posting (key, doc_id, n_words, term, pos) for every place of every
benchmark term in every document, and one with the empty term for the document itself.  ``key`` is a number of the row,
so rows that share a doc_id stay apart.  Postings are written where the documents are read, without a shuffle.

A phrase is a window of a benchmark item.  Its terms are ranked by their postings, rarest first.  Each posting of the
rarest term is a candidate: the phrase would start at its place less its offset.  The list of the next term is
intersected with the candidates after adjusting for its offset, and what is left is intersected with the lists of all
other terms at once.  A list is joined by (key, term, stretch of positions), so that no document or term is one group.
One intersection gives both results: exact matches have every term at its very place, proximity matches have every
term within ``slop`` words of the phrase's place.

What is shuffled: postings of the rarest two terms and of the documents that those two leave, and the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, drop_stored, small, stored, without

WINDOW = 10
#: Rows of phrases or terms up to which a join broadcasts them, at some 100 bytes each; more are shuffled.
BLOCK = 100_000
#: Keys up to which the documents that a search left are picked from the index by a broadcast (some 20 bytes each).
KEYS = 4_000_000
#: Words by which a proximity match may be wider than its phrase.
SLOP = 5
#: Between words of a lower-cased text: what is no digit, no letter of a-z and no character above U+007F.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A text's words, A-Z lower-cased; a null text has none.  No lambda here: it would keep the search out of codegen."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, phrase, terms): each window of each item; an item of fewer words, but not none, is one window."""
    own = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("terms"))
    return cut.select("item_id", F.array_join("terms", " ").alias("phrase"), "terms").distinct()


def postings(docs: DataFrame, terms: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, doc_id, n_words, term, pos): the places, from 1, of each of ``terms`` in each document, stored.

    Each document also has the empty term at place 0.
    """
    mark = terms.sparkSession.range(1).select(F.lit("").alias("term"))
    own = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    every = own.select("key", "doc_id", "n_words", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "term"))
    return stored(every.join(small(terms.unionByName(mark), block), "term").select("key", "doc_id", "n_words", "term", "pos"), "postings")


def _ranked(unique: DataFrame, index: DataFrame, block: int) -> DataFrame:
    """(id, size, terms: array of (n, at, term), rarest first) of the phrases whose terms all occur in some document."""
    each = unique.select("id", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term"))
    counts = stored(index.where("pos > 0").groupBy("term").agg(F.count("*").alias("n")), "counts")
    ranked = each.join(small(counts, block), "term", "left").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))).alias("terms"))
    return ranked.where(F.col("terms")[0].n > 0)


def _met(candidates: DataFrame, index: DataFrame, slop: int, window: int) -> DataFrame:
    """Candidates (id, size, key, start, at, term) with each posting of their term within ``slop`` of the phrase's place, as (.., exact)."""
    wide = window + 2 * slop
    low, high = F.col("start") - slop, F.col("start") + F.col("size") - 1 + slop
    stretch = lambda pos: F.floor(pos / F.lit(wide)).cast("int")
    wanted = candidates.withColumn("part", F.explode(F.array_distinct(F.array(stretch(low), stretch(high)))))
    have = index.select("key", "term", "pos", stretch(F.col("pos")).alias("part"))
    return wanted.join(have, ["key", "term", "part"]).where(F.col("pos").between(low, high)).withColumn("exact", F.col("pos") == F.col("start") + F.col("at"))


def matches(index: DataFrame, unique: DataFrame, window: int = WINDOW, slop: int = SLOP, block: int = BLOCK) -> DataFrame:
    """(key, id, size, start, exact): every exact and proximity match of the phrases ``unique`` (id, terms), stored."""
    ranked = stored(_ranked(unique, index, block), "ranked")
    first = ranked.select("id", "size", F.col("terms")[0].at.alias("at"), F.col("terms")[0].term.alias("term"))
    begun = index.where("pos > 0").join(small(first, block), "term").select("id", "size", "key", (F.col("pos") - F.col("at")).alias("start"))
    # the list of the second rarest term
    second = F.get(F.col("terms"), F.lit(1))
    next_ = ranked.select("id", second.at.alias("at"), second.term.alias("term"))
    begun = begun.join(small(next_, block), "id")
    rare = index.join(small(next_.where("term is not null").select("term").distinct(), block), "term", "left_semi")
    place = ["id", "size", "key", "start"]
    two = _met(begun.where("term is not null"), rare, slop, window).select(place).distinct()
    left = stored(two.unionByName(begun.where("term is null").select(place)), "candidates")
    # the lists of all terms, in the documents that are left
    probes = left.join(small(ranked.select("id", F.explode("terms").alias("t")), block), "id").select(*place, "t.at", "t.term")
    keys = stored(left.select("key").distinct(), "keys")
    there = index.join(small(keys, KEYS), "key", "left_semi")
    each = _met(probes, there, slop, window).groupBy(*place, "at").agg(F.max("exact").alias("exact"))
    found = each.groupBy(*place).agg(F.count("*").alias("n"), F.sum(F.col("exact").cast("int")).alias("n_exact")).where("n = size")
    out = stored(found.select(*place, (F.col("n_exact") == F.col("size")).alias("exact")), "matches")
    drop_stored(ranked, left, keys)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near): one row per row of ``docs``.

    A word inside any occurrence of a benchmark window is hit; ``n_near`` counts the places of windows around which all
    of a window's words stand: a place is one of its rarest term (by all documents' counts, of equal ones the first in
    the window), and around it is up to ``slop`` words before and behind where the window would lie; exact ones count
    too.  Null and wordless texts have no words and no hits; a very long text is many postings; an empty benchmark hits
    nothing; no documents give no rows; null or wordless items have no windows; rows that share a doc_id, also null
    ones, are judged each by its own text.  Other columns are ignored.
    """
    cut = stored(phrases(items, window), "phrases")
    unique = stored(cut.select("phrase", "terms").distinct().withColumn("id", F.monotonically_increasing_id()), "unique")
    terms = unique.select(F.explode("terms").alias("term")).distinct()
    index = postings(docs, terms, block)
    found = matches(index, unique.select("id", "terms"), window, slop, block)
    exact = found.where("exact")
    at = exact.groupBy("key", "start").agg(F.max("size").alias("size"))
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    fresh = at.select("key", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0)))).alias("hit"))
    covered = fresh.groupBy("key").agg(F.sum("hit").alias("n_hit"))
    which = exact.select("key", "id").join(unique.select("id", "phrase"), "id").join(cut.select("phrase", "item_id"), "phrase").select("key", F.col("item_id").cast("string").alias("item_id")).distinct()
    named = which.groupBy("key").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    near = found.groupBy("key").agg(F.count("*").alias("n_near"))
    result = stored(near.join(covered, "key", "left").join(named, "key", "left"), "hits")
    drop_stored(cut, unique, found)
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    out = index.where("term = ''").select("key", "doc_id", F.col("n_words").cast("bigint").alias("n_words")).join(result, "key", "left")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"))


def clean(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the contaminated ones, with all columns whatever their names.

    A row without a doc_id stays; rows that share a doc_id go if one of them is contaminated; an empty benchmark or
    table removes nothing.
    """
    return without(docs, "doc_id", contamination(docs, items, **parameters).where("contaminated").select("doc_id"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS key, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, w[i:i + 9] AS terms, array_to_string(w[i:i + 9], ' ') AS phrase FROM b, LATERAL unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM p),
s AS (SELECT key, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM d, sizes, LATERAL unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
m AS (SELECT s.key, s.i, s.size, p.item_id FROM s JOIN p ON s.phrase = p.phrase AND s.size = p.size),
h AS (SELECT key, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT key, i, size FROM m), LATERAL unnest(range(i, i + size)) AS t(k) GROUP BY key),
n AS (SELECT key, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT key, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY key),
o AS (SELECT key, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d),
c AS (SELECT term, count(*) AS n FROM o GROUP BY term),
u AS (SELECT DISTINCT phrase, size, terms FROM p),
e AS (SELECT phrase, size, terms, unnest(terms) AS term, unnest(range(0, size)) AS at FROM u),
r AS (SELECT phrase, any_value(size) AS size, any_value(terms) AS terms, min(struct_pack(n := coalesce(c.n, 0), at := e.at, term := e.term)) AS r FROM e LEFT JOIN c USING (term) GROUP BY phrase),
q AS (SELECT o.key, count(*) AS n_near FROM r JOIN o ON o.term = r.r.term JOIN d USING (key) WHERE list_has_all(d.w[greatest(o.pos - r.r.at - 5, 1):o.pos - r.r.at + size + 4], r.terms) GROUP BY o.key)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, CAST(coalesce(q.n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (key) LEFT JOIN n USING (key) LEFT JOIN q USING (key)
"""
