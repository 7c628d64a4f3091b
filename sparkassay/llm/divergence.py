"""Divergence of the sources of each language, from stripes that partitions fold themselves.

A task folds whole documents into one hash stripe per language and term: the number of documents that hold the term and
its occurrences by source. Full tables of stripes are spilled as rows; rows of a term then meet by key and are merged
one after another. Divergences are taken from the merged stripes: a term that two sources lack adds the same to their
divergence as any other such term, so only occurrences cost work, never the whole vocabulary for every pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.operators.relational import broadcast_if_small, top_per_group
from sparkassay.session import materialize

#: Documents of a language that a term must occur in.
MIN_DOCS = 3
#: Terms reported per group.
TOP_TERMS = 200
#: Probabilities are whole numbers of this many parts, and one more.
SCALE = 1_000_000_000
#: Counts, and pair sums, a task holds before it spills them.
SPILL = 500_000
#: Stripes in one batch of rows.
OUT_ROWS = 20_000
#: Pairs of occurrences weighed at a time.
CHUNK = 1_000_000

_STRIPE = "lang string, term binary, df bigint, sources array<string>, counts array<bigint>"


def _letters() -> bytes:
    """Byte table: A-Z to a-z, a-z and all non-ASCII bytes as they are, everything else to a space."""
    keep = {*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)}
    return bytes(b + 32 if ord("A") <= b <= ord("Z") else b if b in keep else 32 for b in range(256))


def _stripe_rows(lang: pa.Array, term: pa.Array, df, sizes, sources: pa.Array, counts) -> pa.RecordBatch:
    """Stripes from columns; ``sizes`` says how many of ``sources`` and ``counts`` belong to each row."""
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    lists = [pa.ListArray.from_arrays(at, x) for x in (sources, pa.array(counts, pa.int64()))]
    return pa.record_batch([lang, term, pa.array(df, pa.int64()), *lists], names=["lang", "term", "df", "sources", "counts"])


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; null equals null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    other = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    return other | (null[1:] != null[:-1])


def merged_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Neighbouring rows of one language and term as one row."""
    lang, term, df, sources, counts = batch.columns
    begins = np.concatenate([[True], _changes(lang) | _changes(term)])
    first = np.flatnonzero(begins)
    coded = sources.flatten().dictionary_encode()
    code, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts.flatten().to_numpy(zero_copy_only=False)
    wide = max(1, len(coded.dictionary))
    key = np.repeat(np.cumsum(begins) - 1, sources.value_lengths().to_numpy(zero_copy_only=False)) * wide + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n[order], at) if len(key) else n
    return _stripe_rows(lang.take(pa.array(first)), term.take(pa.array(first)), np.add.reduceat(df.to_numpy(zero_copy_only=False), first),
                        np.bincount(key[at] // wide, minlength=len(first)), coded.dictionary.take(pa.array(key[at] % wide)), sums)


def fold_stripes(docs: DataFrame, spill: int = SPILL) -> DataFrame:
    """Stripes of each task: ``lang, term, df, sources, counts``; a null term lists a language's sources with count 0."""
    table = _letters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[str, dict[bytes, list]] = {}
        groups: dict[str, set[str]] = {}
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, sources in groups.items():
                yield _stripe_rows(pa.array([lang]), pa.array([None], pa.binary()), [0], [len(sources)],
                                   pa.array(list(sources), pa.string()), [0] * len(sources))
            for lang, terms in stripes.items():
                names, rest = list(terms), list(terms.values())
                for k in range(0, len(names), OUT_ROWS):
                    part = rest[k:k + OUT_ROWS]
                    yield _stripe_rows(pa.array([lang] * len(part)), pa.array(names[k:k + OUT_ROWS], pa.binary()), [x[0] for x in part],
                                       [len(x[1]) for x in part], pa.array([y for x in part for y in x[1]], pa.string()),
                                       [y for x in part for y in x[1].values()])

        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns]):
                groups.setdefault(lang, set()).add(source)
                terms = stripes.setdefault(lang, {})
                for term, n in Counter(text.translate(table).split(b" ")).items():
                    if not term:
                        continue
                    stripe = terms.get(term)
                    if stripe is None:
                        terms[term] = [1, {source: n}]
                        held += 1
                    else:
                        stripe[0] += 1
                        by_source = stripe[1]
                        if source in by_source:
                            by_source[source] += n
                        else:
                            by_source[source] = n
                            held += 1
                if held >= spill:
                    yield from rows()
                    stripes, groups, held = {}, {}, 0
        yield from rows()

    return docs.mapInArrow(run, _STRIPE)


def merge_stripes(stripes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One stripe per language and term in at least ``min_docs`` documents, and the null-term stripes.

    Rows come sorted; a batch's last stripe waits, merged, for the next batch. A term has at most a row per task and spill.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(rows: pa.RecordBatch) -> pa.RecordBatch:
            return rows.filter(pc.or_(pc.greater_equal(rows.column(2), min_docs), rows.column(1).is_null()))

        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = merged_rows(batch if waiting is None else pa.concat_batches([waiting, batch.cast(waiting.schema)]))
            yield kept(rows[:-1])
            waiting = rows[-1:]
        if waiting is not None:
            yield kept(waiting)

    return stripes.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, _STRIPE)


def price(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (n + v))`` in whole numbers, three decimal digits at a time; 1 if v is 0."""
    d, r, out = n + v, count + 1, F.lit(0).cast("bigint")
    whole = lambda a, b: F.call_function("div", a, b)
    for _ in range(3):
        r = r * 1000
        out, r = out * 1000 + whole(r, d), r % d
    return F.when(v > 0, out + 1).otherwise(F.lit(1).cast("bigint"))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shared(priced: DataFrame, spill: int = SPILL) -> DataFrame:
    """``a, b, value``: what terms that two sources share add beyond what either adds alone; summed inside tasks."""
    stripes = priced.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "p0")).alias("s")).filter(F.size("s") > 1)

    def excess(p, q, p0, q0):
        f = lambda x, y: (x - y) ** 2 // y
        return f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}

        def flush():
            a, b = zip(*sums) if sums else ((), ())
            out = pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(list(sums.values()), pa.int64())],
                                  names=["a", "b", "value"])
            sums.clear()
            return out

        for batch in batches:
            lists = batch.column(0)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            gid, p, p0 = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            start = np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat(size, size)
            ends = np.cumsum(wide)
            at = 0
            while at < len(gid):
                # Occurrences whose partners fill a chunk; at least one.
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
                one = np.repeat(np.arange(at, to), wide[at:to])
                other = start[one] + np.arange(len(one)) - np.repeat(np.cumsum(wide[at:to]) - wide[at:to], wide[at:to])
                one, other = one[one != other], other[one != other]
                value = excess(p[one], p[other], p0[one], p0[other])
                order = np.lexsort((gid[other], gid[one]))
                a, b, value = gid[one][order], gid[other][order], value[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else []
                for x, y, s in zip(a[first].tolist(), b[first].tolist(), np.add.reduceat(value, first).tolist() if len(a) else []):
                    sums[x, y] = sums.get((x, y), 0) + s
                at = to
                if len(sums) >= spill:
                    yield flush()
        yield flush()

    return stripes.select("s").mapInArrow(run, "a bigint, b bigint, value bigint")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
          min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from the others.

    Terms are runs of ASCII letters and non-ASCII characters, only A-Z lower-cased; a language keeps those in at least
    ``min_docs`` of its documents. Part ``pair`` gives each source its divergence from each other source of the
    language, part ``term`` the ``top_terms`` terms it uses most beyond the language. Nulls count as empty strings;
    sources without any kept term are reported; a language of one source has no pairs, a language without kept terms
    pairs of value 0; an empty table gives no rows. Repeated rows count as documents of their own. Other columns are
    ignored. All arithmetic is in whole numbers; it holds to about 9e15 occurrences and 1e9 terms of a language.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    stripes = materialize(merge_stripes(fold_stripes(rows), min_docs), "stripes")
    kept = stripes.filter("term is not null").select(
        "lang", F.col("term").cast("string").alias("term"), F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        "sources", "counts")
    entries = kept.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select(
        "lang", "term", "total", F.col("e.sources").alias("source"), F.col("e.counts").alias("c"))

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    groups = stripes.filter("term is null").select("lang", F.explode("sources").alias("source"))
    totals = materialize(
        groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", zero("n"), zero("v"), zero("lang_n"))
        .withColumn("p0", price(F.lit(0).cast("bigint"), F.col("n"), F.col("v")))
        .withColumn("gid", F.monotonically_increasing_id()), "totals")
    small = broadcast_if_small(totals, 100_000)

    priced = materialize(
        entries.join(small, ["lang", "source"]).select(
            "lang", "term", "source", "gid", "p0", price(F.col("c"), F.col("n"), F.col("v")).alias("p"),
            price(F.col("total"), F.col("lang_n"), F.col("v")).alias("q")), "priced")
    above = priced.filter("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = top_per_group(above, ["lang", "source"], [F.desc("value"), F.col("item")], top_terms).withColumn("part", F.lit("term"))

    other = small.select("lang", F.col("gid").alias("h"), F.col("p0").alias("h0"))
    apart = F.col("gid") != F.col("h")
    base = totals.join(other, "lang").filter(apart).select(
        F.col("gid").alias("a"), F.col("h").alias("b"), (F.col("v") * gap(F.col("p0"), F.col("h0"))).alias("value"))
    # Terms of one source against a source without them depend on the probability alone, so equal ones are counted first.
    alike = priced.groupBy("lang", "gid", "p0", "p").agg(F.count("*").alias("k"))
    met = alike.join(other, "lang").filter(apart)
    p, p0, h0, k = (F.col(c) for c in ("p", "p0", "h0", "k"))
    alone = met.select(F.inline(F.array(
        F.struct(F.col("gid").alias("a"), F.col("h").alias("b"), (k * (gap(p, h0) - gap(p0, h0))).alias("value")),
        F.struct(F.col("h").alias("a"), F.col("gid").alias("b"), (k * (gap(h0, p) - gap(h0, p0))).alias("value")))))
    sums = (base.unionByName(alone).unionByName(_shared(priced)).groupBy("a", "b")
            .agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("bigint").alias("value")))
    name = small.select(F.col("gid").alias("b"), F.col("source").alias("item"))
    named = sums.join(small.select(F.col("gid").alias("a"), "lang", "source"), "a").join(name, "b")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = named.withColumn("rank", rank).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(terms.select(columns))


#: The same in SQL for a table of documents, every probability written out.
AUDIT_SQL = f"""
    WITH d AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
        FROM documents
    ), tok AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
    grp AS (SELECT DISTINCT lang, source FROM d),
    kept AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCS}),
    cnt AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
    lsize AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
    gsize AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL),
    lp AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (total + 1)) // (n + v) AS q FROM kept JOIN lsize USING (lang)),
    gp AS (
        SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
          1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p
        FROM grp g JOIN kept k USING (lang) JOIN lsize l USING (lang)
        LEFT JOIN gsize s ON s.lang = g.lang AND s.source = g.source
        LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ), term AS (
        SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value
        FROM gp JOIN lp USING (lang, term) WHERE c > 0 AND p > q
    ), far AS (
        SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
        FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), pair AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
        FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    ), ranked AS (
        SELECT 'pair' AS part, * FROM pair UNION ALL SELECT 'term' AS part, * FROM term
    )
    SELECT lang, source, part, item, value::BIGINT AS value,
      row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM ranked QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
