"""Personal data, licences, languages, the archive and the pipeline against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkassay.llm import decontam, jaccard, langid, licence, pii, queries, warc

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SMALL = "/root/testdata/sf0.001"


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        d = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in d) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(t):
    return sorted((m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(BASE.items())
                  for m in re.finditer(p, t or "") if holds(kind, m.group()))


CASES = [None, "", "x@y.zz and a@b.c_d@e.f", "4111 1111 1111 1111 or 4111-1111-1111-1112", "é😀 1.2.3.4.5.6.7.8 000255.1.1.1 256.1.1.1",
         "+49 (30) 1234-567 +1 2", "IBAN DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00", "mail: a@b.co " * 50, "1 2 3 " * 400]


def test_personal_data(spark, docs, texts):
    df = docs.select("doc_id", "text", "score").unionByName(
        spark.createDataFrame([(1000 + i, t, "q") for i, t in enumerate(CASES)], "doc_id long, text string, score string"))
    every = {**dict(enumerate(texts)), **{1000 + i: t for i, t in enumerate(CASES)}, None: "no id here"}
    for r in pii.report(df).collect():
        spans = base_spans(every[r.doc_id])
        line = ",".join(f"{k}:{a}:{e}" for a, _, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), every[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in BASE]
        if r.doc_id == 1006:
            assert r.spans.startswith("iban:5:32") and r.spans.count("iban") == 1
    assert pii.report(df.filter("doc_id = -5")).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(df.filter("doc_id >= 1000")).collect()}
    assert clean[1000] is None and clean[1002] == "[EMAIL] and [EMAIL][EMAIL]" and clean[1006].startswith("IBAN [IBAN] and DE88")


def test_account_numbers_end_where_their_country_says(spark):
    numbers = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606",
               "NL91 ABNA 0417 1643 00", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "LC55 HEMM 0001 0001 0012 0012 0002 3015"]
    tails = ["", " BIC COBADEFF", " EUR 50", " 2024", " A", ", DE88 3704 0044 0532 0130 00", " DE89 3704 0044 0532 0130 00"]
    rows = [(i, f"AB12 pay {n}{t}") for i, (n, t) in enumerate((n, t) for n in numbers for t in tails)]
    rows += [(1000 + i, f"DE89370400440532013000{t}") for i, t in enumerate(("EUR", "0", "x"))] + [(1010, "IBAN DE88 3704 0044 0532 0130 00 EUR 50")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans or "" for r in pii.report(frame).collect()}
    for k, (n, t) in enumerate((n, t) for n in numbers for t in tails):
        spans = [x for x in got[k].split(",") if x.startswith("iban")]
        assert spans == [f"iban:9:{9 + len(n)}"] + [f"iban:{10 + len(n)}:{9 + len(n) + len(t)}"] * (t == tails[-1]), (n, t)
    assert not [k for k in got if k >= 1000 and "iban" in got[k]]
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert clean[1] == "AB12 pay [IBAN] BIC COBADEFF" and clean[2] == "AB12 pay [IBAN] EUR 50"


@pytest.mark.parametrize("text", ["1" * 60_000, "a" * 60_000, "a." * 40_000, "x@" + "a." * 40_000, "+1" + "(" * 60_000, "9 " * 30_000])
def test_long_runs_end(spark, text):
    assert pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1


def test_licences(spark, docs, texts):
    cases = ["MIT License mit license", "GNU General Public License", "cc by cc by", "K Mit-License!", "mit " * 2000,
             "THIS IS FREE AND UNENCUMBERED SOFTWARE released into the public domain", "free and unencumbered software"]
    every = {**dict(enumerate(texts)), **{1000 + i: t for i, t in enumerate(cases)}, None: "no id here"}
    df = docs.select("doc_id", "text", "score").unionByName(
        spark.createDataFrame([(1000 + i, t, "q") for i, t in enumerate(cases)], "doc_id long, text string, score string"))
    for r in licence.scan(df).collect():
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in every[r.doc_id] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at = [(i, label) for p, label in licence.PHRASES.items() for q in [p.split()] for i in range(len(w)) if w[i:i + len(q)] == q]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert r.doc_id != 1005 or r.labels == "unlicense-text"
    assert licence.scan(df.filter("doc_id = -5")).count() == 0


def test_language(spark, docs):
    rows = {r.doc_id: r for r in langid.predict(docs).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[0].score == 0
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.predict(docs.filter("doc_id = -5")).count() == 0
    unknown = langid.predict(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    named = langid.predict(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert named.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.98


def test_language_stage(spark):
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    rows = [(1, "some words", None), (2, "12 34 !", None), (3, None, None), (4, "", None), (5, "слово", None), (6, "語", None)]
    schema = "doc_id long, text string, lang string"
    kept = stage(spark, spark.createDataFrame(rows, schema), "")
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(r.doc_id for r in kept.collect()) == [1, 5, 6]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    greek = "αβγδεζηθικλμνξοπρστυφχψω"
    odd = [(-1, " ".join(greek[k % 9:k % 9 + 6] for k in range(60)), None), (-2, " ".join("zqxjkvwq"[k % 5:] + "qzzx" for k in range(60)), None),
           (-3, greek, None), (-4, "12 34 " * 60, None)]
    clean = [r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    kept = [r.doc_id for r in stage(spark, docs.unionByName(spark.createDataFrame(odd, schema)), "").collect()]
    # A short text is not judged by its score.
    assert sorted(kept) == sorted(clean + [-3])


def test_archive(spark, tmp_path):
    long = "x" * 150
    rows = [(3, "u3", long), (1, "u1", long), (2, "u\r\n2", "é" * 60), (4, None, None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
            (1, "u1", long), (None, "n", long), (None, "n", "only without an id " * 10)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = warc.write_archive(pages)
    records = {r.page_id: r for r in warc.read_archive(spark, path).filter("page_id is not null").collect()}
    assert warc.read_archive(spark, path).count() == len(rows)
    assert {i: (r.record_type, r.refers_to) for i, r in records.items()} == {
        1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None),
        6: ("response", None), 7: ("response", None)}
    for i, _, html in rows:
        if i is not None:
            body = (html or "").encode()
            assert bytes(records[i].payload) == body and records[i].digest == hashlib.sha256(body).hexdigest()
    assert b"u%0D%0A2\r\n" in bytes(records[2].header)
    warc.export_files(spark, path, f"{tmp_path}/warc")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == len(rows) and data.endswith(b"\r\n\r\n")
    assert spark.read.parquet(f"{path}/payloads").groupBy("digest").count().filter("count > 1").isEmpty()
    assert warc.stored_pages(pages.filter("page_id < 0")).count() == 0


def shingles(text):
    """Five-word shingles; letters of unspaced scripts are words."""
    words = re.sub("([\u4e00-\u9fff])", r" \1 ", text).lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each(rows):
    """Ids that stay: the smallest of every component over pairs of Jaccard 0.8, all pairs compared."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = top(i), top(j)
                label[max(x, y)] = min(x, y)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[top(i)] = min(key, least.get(top(i), key))
    return set(least.values())


def test_stages_keep_rows_columns_and_unspaced_scripts(spark):
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    one, chinese = prose(80), "".join(chr(0x4e00 + r.randrange(3000)) for _ in range(150))
    other = chinese[:70] + "\u4e00" + chinese[71:]
    rows = [(1, one), (1, prose(60)), (2, one + " x"), (3, chinese), (4, other), (5, prose(40)), (5, None), (None, one), (6, one), (1, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own", "mine") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, score string, _id string").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    got = stages["near_duplicates"](spark, docs, SMALL)
    assert got.columns == docs.columns
    # Two rows of id 1 have different texts and both stay; the row that repeats the first of them goes.
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=repr) == sorted(
        [(1, rows[0][1]), (1, rows[1][1]), (3, chinese), (5, rows[5][1]), (5, None), (None, one)], key=repr)
    named = stages["language_id"](spark, docs, SMALL)
    assert named.columns == docs.columns and {x.score for x in named.collect()} == {"own"}
    bench = spark.createDataFrame([(1, " ".join(one.split()[10:40]))], "item_id long, text string")
    clean = lambda **o: sorted(((x.doc_id, x.text) for x in decontam.clean(docs, bench, **o).collect()), key=repr)
    want = sorted([(i, t) for i, t in rows if i is None or t not in (one, one + " x")], key=repr)
    assert clean() == want == clean(block_bytes=10)
    empty = docs.filter("doc_id = -1")
    assert all(stages[n](spark, empty, SMALL).count() == 0 for n in stages)


def test_unlinked_members_meet_in_blocks(spark, monkeypatch):
    r = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for p in r.sample(range(120), r.choice([1, 2, 4, 6])):
            words[p] = f"n{r.randrange(60)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = one_of_each(rows)
    assert 1 < len(want) < 90
    assert {x.doc_id for x in jaccard.keep_one(docs).collect()} == want
    whole = jaccard.unlinked_members
    monkeypatch.setattr(jaccard, "unlinked_members", lambda members, sets, similarity: whole(members, sets, similarity, block=7))
    assert {x.doc_id for x in jaccard.keep_one(docs).collect()} == want
    assert {x.component_id for x in jaccard.near_duplicates(docs).collect()} == want


def test_pipeline_matches_its_parts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    bench = [x.text for x in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = [d for d in docs if d.text and any(c.isalpha() for c in d.text)]
    frame = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")
    kept = one_of_each([(d.doc_id, d.text) for d in kept])
    kept = [d for d in docs if d.doc_id in kept]

    def words(t):
        return f" {' '.join(re.findall(r'[a-z0-9\x80-\U0010ffff]+', t.lower()))} "

    # The small table holds its passages as they are, so a plain search finds what the edit search finds.
    kept = [d for d in kept if not any(words(b) in words(d.text) for b in bench)]
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} == {d.doc_id for d in kept}
    filled = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
    for r in out:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["personal_data"](spark, frame, SMALL)
    assert clean.columns == frame.columns
    assert not [r for r in clean.collect() if base_spans(r.text)]


def test_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
