"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased, every run of characters that aren't letters becomes one space,
and a space is put at both ends. Its grams are all substrings of 1 to 3 characters,
but the single space and those with a space inside. Ordered by falling frequency, then
by code points, the first ``TOP`` make a profile. The out-of-place distance from a
text to a language is the mean, over the text's profile, of how far each gram's rank is
from its rank in the language's profile, ``TOP`` where it isn't there.

Profiles are a classifier, fitted on a bounded sample: of each label, the
``ROWS_PER_LABEL`` rows that come first by ``md5(id)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import checkpointed, col, fresh, table, text_of
from .words import as_strings, slices

TOP = 300
#: The sample's keys are broadcast if they are no more than this.
BROADCAST_ROWS = 200_000
#: The bound on labelled rows that a language's profile is fitted on.
ROWS_PER_LABEL = 400
#: A text is rejected if another language is nearer than its label's by this share of TOP.
MARGIN = 0.1
_LETTER: list[np.ndarray] = []
_SPACE = 32


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def _spaced(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts, back to back, and each one's text."""
    parts = [np.frombuffer((" " + t + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    code = np.concatenate(parts)
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    letter = _letters()[code]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    return np.where(letter, code, _SPACE)[keep].astype(np.uint32), doc[keep]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, gram and count of every gram of every text; grams sort as their strings do."""
    code, doc = _spaced([t.lower() for t in texts])
    alphabet, dense = np.unique(code, return_inverse=True)
    bits = max(1, int(len(alphabet)).bit_length())
    dense = dense.astype(np.uint64) + np.uint64(1)
    b, space, n = np.uint64(bits), code == _SPACE, len(code)
    one = dense << (b * np.uint64(2))
    base = doc.astype(np.uint64) << np.uint64(3 * bits)
    same = doc[1:] == doc[:-1]
    keys = [(base + one)[~space]]
    if n > 1:
        two = one[:-1] + (dense[1:] << b)
        keys.append((base[:-1] + two)[same])
        if n > 2:
            keys.append((base[:-2] + two[:-1] + dense[2:])[same[:-1] & same[1:] & ~space[1:-1]])
    keys = np.concatenate(keys)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keys)))
    key = keys[first]
    mask = np.uint64((1 << bits) - 1)
    table_ = np.concatenate([[0], alphabet]).astype(np.uint64)
    gram = np.zeros(len(key), np.uint64)  # 21 bits a character
    for j in range(3):
        gram = (gram << np.uint64(21)) + table_[((key >> (b * np.uint64(2 - j))) & mask).astype(np.int64)]
    return (key >> np.uint64(3 * bits)).astype(np.int64), gram, count


def top_grams(texts: list[str], top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, gram and 1-based rank of each text's most frequent grams."""
    doc, gram, count = _grams(texts)
    order = np.argsort((doc.astype(np.uint64) << np.uint64(40)) + np.uint64((1 << 40) - 1) - count.astype(np.uint64), kind="stable")
    doc, gram = doc[order], gram[order]
    start = np.searchsorted(doc, np.arange(len(texts)))
    rank = np.arange(len(doc)) - start[doc] + 1
    keep = rank <= top
    return doc[keep], gram[keep], rank[keep]


def _profile(texts: list[str], top: int) -> np.ndarray:
    grams, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k in range(0, len(texts), 64):
        _, gram, count = _grams(texts[k : k + 64])
        grams.append(gram)
        counts.append(count)
    gram, where = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(counts), minlength=len(gram))
    return gram[np.argsort(-total, kind="stable")][:top]


def fit_profiles(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", rows: int = ROWS_PER_LABEL, top: int = TOP) -> dict[str, np.ndarray]:
    """Profiles by label: grams by rank.

    Rows with a null label or text aren't used; an empty table gives no profiles.
    Repeated rows count each time that they are drawn; ties in md5 are broken by a hash of
    the text, then they are equal. Ids and labels are ranked with a limit on the map side;
    the driver gets ``rows`` texts a label at most.
    """
    x = docs.select(
        F.md5(F.coalesce(col(id_col).cast("string"), F.lit(""))).alias("h"), col(label_col).cast("string").alias("label"), text_of(docs, text_col).alias("text")
    ).where(F.col("label").isNotNull() & F.col("text").isNotNull())
    first = Window.partitionBy("label").orderBy("h", "x")
    drawn = x.select("label", "h", F.xxhash64("text").alias("x")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= rows)
    times = checkpointed(drawn.groupBy("label", "h", "x").agg(F.count(F.lit(1)).alias("times")))
    # at most ``rows`` a label; with so many labels that this isn't small, the join shuffles
    times = F.broadcast(times) if times.count() <= BROADCAST_ROWS else times
    # repeated rows meet all their repetitions in the join, so it is enough to keep one of each
    texts = x.withColumn("x", F.xxhash64("text")).join(times, ["label", "h", "x"]).groupBy("label", "h", "x").agg(F.first("text").alias("text"), F.first("times").alias("times"))
    by: dict[str, list[tuple]] = {}
    for r in texts.toLocalIterator():
        by.setdefault(r.label, []).append((r.h, r.x, r.text, r.times))
    out = {lang: _profile([t for _, _, text, times in sorted(by[lang]) for t in [text] * times], top) for lang in sorted(by)}
    return {lang: p for lang, p in out.items() if len(p)}


def distances(texts: list[str], profiles: list[np.ndarray], top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Mean out-of-place distance of each text (rows) to each profile, and the texts' numbers of grams."""
    doc, gram, rank = top_grams(texts, top)
    vocabulary = np.unique(np.concatenate([*profiles, np.zeros(0, np.uint64)]))
    size = np.bincount(doc, minlength=len(texts))
    where = np.searchsorted(vocabulary, gram)
    where[where == len(vocabulary)] = 0
    known = vocabulary[where] == gram if len(vocabulary) else np.zeros(len(gram), bool)
    out = np.zeros((len(texts), len(profiles)))
    for k, p in enumerate(profiles):
        ranks = np.zeros(len(vocabulary) + 1, np.int64)
        ranks[np.searchsorted(vocabulary, p)] = np.arange(1, len(p) + 1)
        there = ranks[where]
        far = np.where(known & (there > 0), np.abs(there - rank), top)
        out[:, k] = np.bincount(doc, weights=far, minlength=len(texts)) / np.maximum(size, 1)
    return out, size


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", label_col: str = "lang", margin: float = MARGIN, top: int = TOP) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (predicted, distance, label_distance, kept), whose name is returned too.

    A null, empty or letterless text has a null language and isn't kept. Of equal
    distances the first language by name wins. A text is kept if its label's distance is above
    the least by no more than ``margin * top``, or if its label is null or has no profile: then
    nothing speaks against it. Whole texts count, however long. All columns stay, repeated rows too.
    """
    names, arrays = list(profiles), [profiles[x] for x in profiles]
    kind = "predicted string, distance double, label_distance double, kept boolean"

    @F.arrow_udf(returnType=f"struct<{kind.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean')}>")
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, label in batches:
            labels = label.to_pylist()
            best: list = []
            least: list = []
            own: list = []
            kept: list = []
            for start, part in slices(text):
                d, size = distances(part.to_pylist(), arrays, top)
                for i in range(len(part)):
                    lang = labels[start + i]
                    if not size[i]:
                        row = (None, None, None, False)
                    elif not names:
                        row = (None, None, None, True)
                    else:
                        k = int(d[i].argmin())
                        mine = float(d[i, names.index(lang)]) if lang in names else None
                        row = (names[k], float(d[i, k]), mine, mine is None or mine - float(d[i, k]) <= margin * top)
                    for to, v in zip((best, least, own, kept), row):
                        to.append(v)
            yield pa.StructArray.from_arrays(
                [pa.array(best, pa.string()), pa.array(least, pa.float64()), pa.array(own, pa.float64()), pa.array(kept, pa.bool_())], names=["predicted", "distance", "label_distance", "kept"]
            )

    name = fresh(docs, "language")
    return docs.withColumn(name, judge(text_of(docs, text_col), col(label_col).cast("string"))), name


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = ROWS_PER_LABEL, margin: float = MARGIN) -> DataFrame:
    """A row for each row of ``docs``: id, label, predicted language, both distances, and whether it is kept.

    See ``identify`` and ``fit_profiles`` for nulls, ties and texts without letters; other
    columns, whatever their names, are left out.
    """
    profiles = fit_profiles(docs, text_col, label_col, id_col, rows)
    slim = docs.select(col(id_col).alias("doc_id"), col(label_col).cast("string").alias("lang"), text_of(docs, text_col).alias("text"))
    judged, name = identify(slim, profiles, "text", "lang", margin)
    return judged.select("doc_id", "lang", *[F.col(f"{name}.{c}").alias(c) for c in ("predicted", "distance", "label_distance", "kept")])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects, columns unchanged."""
    judged, name = identify(docs, fit_profiles(docs))
    return judged.where(col(name)["kept"]).drop(name)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH t AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, text IS NULL ORDER BY md5(coalesce(doc_id::VARCHAR, ''))) <= {ROWS_PER_LABEL} AND lang IS NOT NULL AND text IS NOT NULL AS drawn,
    ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS x FROM documents
),
chars AS MATERIALIZED (
  SELECT doc_id, lang, drawn, unnest(c) AS a, unnest(c[2:] || ['']) AS b, unnest(c[3:] || ['', '']) AS e FROM (SELECT *, string_split(x, '') AS c FROM t WHERE len(x) > 2)
),
gram AS (
  SELECT doc_id, lang, drawn, a AS g FROM chars UNION ALL SELECT doc_id, lang, drawn, a || b FROM chars WHERE b <> '' UNION ALL SELECT doc_id, lang, drawn, a || b || e FROM chars WHERE e <> '' AND b <> ' '
),
good AS MATERIALIZED (SELECT * FROM gram WHERE g <> ' '),
mine AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, g) AS r FROM good GROUP BY doc_id, g QUALIFY r <= {TOP}),
profile AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, g) AS r FROM good WHERE drawn GROUP BY lang, g QUALIFY r <= {TOP}),
dist AS (
  SELECT m.doc_id, l.lang AS name, sum(coalesce(abs(p.r - m.r), {TOP}))::DOUBLE / count(*) AS d
  FROM mine m CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.g = m.g GROUP BY m.doc_id, l.lang
),
best AS (SELECT doc_id, arg_min(name, (d, name)) AS predicted, min(d) AS distance FROM dist GROUP BY doc_id)
SELECT t.doc_id, t.lang, b.predicted, b.distance, o.d AS label_distance, b.predicted IS NOT NULL AND coalesce(o.d - b.distance <= {MARGIN * TOP}, true) AS kept
FROM t LEFT JOIN best b ON b.doc_id = t.doc_id LEFT JOIN dist o ON o.doc_id = t.doc_id AND o.name = t.lang
"""
