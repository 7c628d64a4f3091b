"""Language identification with hyperdimensional profiles of letter n-grams.

Every letter has a random vector of +1 and -1 drawn from its code point. An n-gram binds its letters: the vectors,
each rotated by its place, are multiplied component by component. A text bundles its n-grams by adding them, a
language's prototype bundles the unit bundles of its labelled texts, and a text is compared with the prototypes
by cosine. Word boundaries take part as one more symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.llm.worker import give_back, spread, worker_cache

DIM = 1024
GRAM = 3
#: Labelled texts the prototypes are learned from, at most about this many per language, chosen by hash of the id.
FIT_DOCS = 4_000
#: N-gram vectors remembered by one Python worker (about 40 MB) before it starts afresh.
MEMO_GRAMS = 40_000
#: Documents bundled at a time.
GROUP = 64
UNDETERMINED = "und"


def letter_vector(symbol: int, dim: int) -> np.ndarray:
    return np.random.default_rng([symbol, dim]).integers(0, 2, dim, dtype=np.int8) * 2 - 1


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text with a single 0 for each run of anything but letters, at both ends too."""
    t = "".join([c if c.isalpha() else " " for c in text.lower()]) if not text.isascii() else text.lower()
    codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = (codes >= 97) & (codes <= 122) | (codes > 127)
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]])
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


def bundler(dim: int = DIM, gram: int = GRAM, memo_grams: int = MEMO_GRAMS):
    """``bundle(texts) -> float matrix``: the bundle of each text, a zero row where it has no letters."""

    def make():
        return {"letters": {}, "row": {}, "table": np.zeros((0, dim), dtype=np.int8)}

    state = worker_cache(f"langid:{dim}:{gram}:{memo_grams}", make)

    def vector_of(key: int) -> np.ndarray:
        out = np.ones(dim, dtype=np.int8)
        for place in range(gram):
            symbol, key = key & 0x1FFFFF, key >> 21
            if symbol not in state["letters"]:
                if len(state["letters"]) >= memo_grams:
                    state["letters"].clear()
                state["letters"][symbol] = letter_vector(symbol, dim)
            out *= np.roll(state["letters"][symbol], place)
        return out

    def rows_of(keys: np.ndarray) -> np.ndarray:
        """The n-gram vectors of distinct keys; more keys than the memo holds are made for this call only."""
        new = [k for k in keys.tolist() if k not in state["row"]]
        if len(state["row"]) + len(new) > memo_grams:
            state["row"], state["table"], new = {}, np.zeros((0, dim), dtype=np.int8), keys.tolist()
        if new:
            made = np.stack([vector_of(k) for k in new])
            if len(new) > memo_grams:
                return made
            state["row"].update(zip(new, range(len(state["row"]), len(state["row"]) + len(new))))
            state["table"] = np.concatenate([state["table"], made])
        return state["table"][[state["row"][k] for k in keys.tolist()]]

    def bundle(texts: list[str | None]) -> np.ndarray:
        keys, owner = [], []
        for k, t in enumerate(texts):
            codes = letter_codes(t) if t else np.zeros(0, dtype=np.int64)
            if codes.any():
                grams = sum(codes[i:len(codes) - gram + 1 + i] << (21 * i) for i in range(gram))
                keys.append(grams)
                owner.append(np.full(len(grams), k))
        out = np.zeros((len(texts), dim), dtype=np.float32)
        if keys:
            distinct, column = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.bincount(np.concatenate(owner) * len(distinct) + column, minlength=len(texts) * len(distinct))
            counts = counts.reshape(len(texts), -1).astype(np.float32)
            for k in range(0, len(distinct), 8192):
                out += counts[:, k:k + 8192] @ rows_of(distinct[k:k + 8192]).astype(np.float32)
        return out

    return bundle


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", dim: int = DIM,
          gram: int = GRAM, fit_docs: int = FIT_DOCS) -> dict[str, np.ndarray]:
    """A prototype per non-null language.

    Texts are chosen per language by a hash of the id, all of them while a language has no more than ``fit_docs``.
    Every task adds its bundles per language and component, and the sums are combined before they shuffle; the
    driver gets languages times ``dim`` numbers.
    """
    known = docs.filter(F.col(lang).isNotNull())
    counts = {r[lang]: r["n"] for r in known.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, fit_docs / n))])
    chosen = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < F.element_at(share, F.col(lang)) * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = bundler(dim, gram)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(langs), GROUP):
                vectors = unit(bundle(texts[k:k + GROUP].to_pylist()))
                for name in set(langs[k:k + GROUP]):
                    mine = [i for i, x in enumerate(langs[k:k + GROUP]) if x == name]
                    sums[name] = sums.get(name, 0) + vectors[mine].sum(axis=0, dtype=np.float64)
        for name, total in sums.items():
            # Whole numbers add up alike in any order.
            yield pa.record_batch([pa.array([name] * dim), pa.array(np.arange(dim)), pa.array(np.rint(total * 1e6).astype(np.int64))],
                                  names=["lang", "place", "value"])

    parts = spread(chosen.select(lang, text)).mapInArrow(run, "lang string, place bigint, value bigint")
    out = {name: np.zeros(dim) for name in counts}
    for r in parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect():
        out[r["lang"]][r["place"]] = r["value"]
    return {name: v for name, v in sorted(out.items()) if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dim: int = DIM, gram: int = GRAM,
             lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add ``lang_out`` and ``score_out`` (cosine with the prototype, at least 0) to every row.

    A null text, or one without letters, or an empty model gives ``und`` and score 0; equal cosines go to the first
    language by name. Existing columns of these two names are replaced. Texts are compared where they are read.
    """
    names = list(prototypes)
    matrix = unit(np.stack([prototypes[n] for n in names])).astype(np.float32) if names else np.zeros((0, dim), np.float32)
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = bundler(dim, gram)
        for batch in batches:
            texts, langs, scores = batch.column(batch.schema.get_field_index(text)), [], []
            for k in range(0, batch.num_rows, GROUP):
                vectors = unit(bundle(texts[k:k + GROUP].to_pylist()))
                cosines = vectors @ matrix.T if names else np.zeros((len(vectors), 1))
                best = cosines.argmax(axis=1)
                found = vectors.any(axis=1) & bool(names)
                langs += [names[b] if f else UNDETERMINED for b, f in zip(best, found)]
                scores += np.where(found, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0).astype(float).tolist()
            yield pa.record_batch([batch.column(c) for c in range(batch.num_columns)] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                  names=[*batch.schema.names, lang_out, score_out])
        give_back()

    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    return spread(rows).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is learned from like one that does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document, learned from those that are not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).withColumn("held_out", held_out())
    model = learn(rows.filter(~F.col("held_out")), fit_docs=fit_docs)
    return identify(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
