"""Language identification: the family first, then one-versus-one linear support vector machines within it.

A text is its frequencies of pairs and (hashed) triples of lower-cased UTF-8 bytes. All models are linear
in these, so a text is scored by adding up table rows over its whole length: no feature vector is built.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import binary_of, text_batches, tidied

#: Documents of each language that a fit uses at most, and of all together: of many languages it takes fewer of each.
SAMPLE = 1_000
SAMPLE_OF_ALL = 20_000
#: Documents of other families that a machine sees for each one of its own.
OTHERS = 4
#: Bytes of the weight table, which is broadcast: with many machines n-grams are hashed to fewer rows.
MOST_BYTES = 128_000_000
UNKNOWN = "und"

#: Families of ISO 639-1 codes. A code that is not listed belongs to the family of what is left.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca co es fr gl it la lt oc pt rm ro sc wa",
    "slavic": "be bg bs cs cu hr mk pl ru sh sk sl sr uk",
    "baltic_celtic_greek": "br cy el ga gd gv hy kw lv sq",
    "uralic": "et fi hu kv se",
    "turkic": "av az ba ce cv kk ky tk tr tt ug uz",
    "indo_iranian": "as bh bn fa gu hi ks ku mr ne os pa pi ps sa sd si tg ur",
    "semitic": "aa am ar ha he iw mt om so ti",
    "dravidian": "kn ml ta te",
    "east_asian": "bo dz ii ja km ko lo my th vi za zh",
    "austronesian": "bi ch fj haw ho id jv mg mh mi ms na sm su tl to ty",
    "african": "ak bm ee ff hz ig kg ki kj kr lg ln lu nd ng nr ny rn rw sg sn ss st sw tn ts tw ve wo xh yo zu",
    "caucasian_basque_constructed": "ab eo eu ia ie io ka vo",
    "american": "ay cr gn ht ik iu kl nv oj qu",
}
OTHER_FAMILY = "other"
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)
#: Bits of the codes of pairs, and of triples, where memory allows.
BITS = 16
_SCALE = 30.0
_BLOCK = 1 << 20
SEED = 5


def family_of(language: str) -> str:
    return _FAMILY.get(language.split("-")[0].split("_")[0].lower(), OTHER_FAMILY)


def _grams(raw: np.ndarray, starts: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pair and triple codes at each byte; texts begin at ``starts`` as if after spaces."""
    now = _LOWER[raw].astype(np.uint32)
    one = np.concatenate([[np.uint32(32)], now[:-1]])
    one[starts] = 32
    two = np.concatenate([[np.uint32(32)], one[:-1]])
    two[starts] = 32
    pair = now | one << np.uint32(8)
    triple = ((pair | two << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - bits)
    if bits < 16:
        pair = (pair * np.uint32(2654435761)) >> np.uint32(32 - bits)
    return pair, triple + np.uint32(1 << bits)


def _vectors(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, codes, shares)."""
    for batch in batches:
        at, raw = binary_of(batch.column(1))
        codes, shares = [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            code, count = np.unique(np.concatenate(_grams(raw[a:b], np.zeros(1, int), bits)), return_counts=True) if b > a else (np.zeros(0, np.uint32), np.zeros(0))
            codes.append(code.astype(np.int32))
            shares.append((count * (_SCALE / max(1, b - a))).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["lang", "codes", "shares"])


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, bits: int = BITS, cost: float = 4.0, epochs: int = 12) -> np.ndarray:
    """Weights (the last one is the bias) of a squared-hinge linear machine, by dual coordinate descent."""
    w, alpha = np.zeros((2 << bits) + 1), np.zeros(len(rows))
    extra = 1 / (2 * cost)
    norms = [float(v @ v) + 1 + extra for _, v in rows]
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            code, value = rows[i]
            gradient = sign[i] * (w[code] @ value + w[-1]) - 1 + alpha[i] * extra
            new = max(alpha[i] - gradient / norms[i], 0.0)
            if new != alpha[i]:
                change = (new - alpha[i]) * sign[i]
                w[code] += change * value
                w[-1] += change
                alpha[i] = new
    return w


@dataclass
class Contest:
    """Machines among a few names: which columns of the weight table decide which pair, or speak for which name."""

    names: list[str]
    pairs: list[tuple[int, int, int]] = field(default_factory=list)
    alone: list[int] = field(default_factory=list)

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner of each row, by votes and then margins or by the largest margin; and its confidence, from its closest rival."""
        n, k = len(margins), len(self.names)
        if self.alone:
            own = margins[:, self.alone]
            best = own.argmax(axis=1)
            ordered = np.sort(own, axis=1)
            sure = (ordered[:, -1] - ordered[:, -2]) / 2
            return best, 1 / (1 + np.exp(-3 * np.clip(sure, -20, 20)))
        votes, closest = np.zeros((n, k)), np.full((n, k), np.inf)
        for a, b, column in self.pairs:
            m = margins[:, column]
            for who, its in ((a, m), (b, -m)):
                votes[:, who] += (its > 0) + 0.49 * np.tanh(its) / max(1, k)
                closest[:, who] = np.minimum(closest[:, who], its)
        best = votes.argmax(axis=1)
        sure = closest[np.arange(n), best]
        return best, np.where(np.isinf(sure), 1.0, 1 / (1 + np.exp(-3 * np.clip(sure, -20, 20))))


@dataclass
class LanguageModel:
    families: Contest
    within: list[Contest]
    weights: np.ndarray
    bias: np.ndarray
    bits: int = BITS

    def margins(self, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Margins of every machine for every text, over whole texts, a block of bytes at a time."""
        size = np.diff(at)
        total = np.zeros((len(size), len(self.bias)))
        full = np.flatnonzero(size)
        begins = at[:-1][full]
        for lo in range(int(at[0]), int(at[-1]), _BLOCK):
            hi = min(lo + _BLOCK, int(at[-1]))
            before = max(int(at[0]), lo - 2)  # a text that began earlier needs its last two bytes
            first, last = np.searchsorted(begins, lo, side="right") - 1, np.searchsorted(begins, hi, side="left")
            inner = begins[np.searchsorted(begins, before) : last] - before
            cuts = np.maximum(begins[first:last], lo) - lo
            for code in _grams(raw[before:hi], inner, self.bits):
                total[full[first:last]] += np.add.reduceat(self.weights[code[lo - before :]], cuts, axis=0, dtype=np.float64)
        return total * (_SCALE / np.maximum(size, 1))[:, None] + self.bias

    def predict(self, at: np.ndarray, raw: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = self.margins(at, raw)
        family, sure = self.families.decide(margins)
        names, score = np.empty(len(family), object), sure.copy()
        for f, contest in enumerate(self.within):
            rows = np.flatnonzero(family == f)
            if len(rows):
                language, closer = contest.decide(margins[rows])
                names[rows] = np.array(contest.names, object)[language]
                score[rows] *= closer
        return names.tolist(), score


def machines_of(languages: list[str]) -> int:
    """How many machines these languages need: one a family (one in all for two), one for each pair within a family."""
    sizes = Counter(family_of(x) for x in languages)
    tops = len(sizes) if len(sizes) > 2 else len(sizes) - 1
    return tops + sum(n * (n - 1) // 2 for n in sizes.values())


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most_bytes: int = MOST_BYTES) -> LanguageModel | None:
    """Learn from rows with a language; None if there are none.

    Rows with null language, null text or no letter take no part; texts of any length do, in full. Of each language
    ``sample`` rows are drawn, fewer if there are so many languages that all would be more than SAMPLE_OF_ALL: those
    with the smallest hash of the id. Their n-gram shares come to the driver, never texts.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(SEED), F.col(id_col)).alias("h")).where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counted = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count().collect()
    if not counted:
        return None
    sample = max(20, min(sample, SAMPLE_OF_ALL // len(counted)))
    needed = max(1, machines_of([r["lang"] for r in counted]))
    bits = BITS
    while bits > 8 and needed * 4 * (2 << bits) > most_bytes:
        bits -= 1
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    first = rows.select("lang", "h").withColumn("place", place).where(F.col("place") <= sample)
    cuts = {r["lang"]: r["cut"] for r in first.groupBy("lang").agg(F.max("h").alias("cut")).collect()}
    if not cuts:
        return None
    cut = F.element_at(F.create_map(*(F.lit(x) for pair in sorted(cuts.items()) for x in pair)), F.col("lang"))
    few = rows.where(F.col("lang").isin(list(cuts)) & (F.col("h") <= cut))  # more than were wanted where ids are equal
    few = few.withColumn("place", place).where(F.col("place") <= sample).select("lang", "text")
    drawn = few.mapInArrow(tidied(lambda b: _vectors(b, bits)), "lang string, codes array<int>, shares array<float>").toArrow()
    langs = drawn.column(0).to_pylist()
    order = sorted(range(len(langs)), key=lambda i: langs[i])
    each = []
    for chunk_codes, chunk_shares in zip(drawn.column(1).chunks, drawn.column(2).chunks, strict=True):
        each += [(c.values.to_numpy(), v.values.to_numpy().astype(np.float64)) for c, v in zip(chunk_codes, chunk_shares, strict=True)]
    langs, each = [langs[i] for i in order], [each[i] for i in order]
    known = sorted(set(langs))
    families = sorted({family_of(x) for x in known})
    marks = [family_of(x) for x in langs]
    machines: list[np.ndarray] = []

    def machine(own: list[int], others: list[int]) -> int:
        machines.append(linear_svm([each[i] for i in own + others], np.repeat([1.0, -1.0], [len(own), len(others)]), bits).astype(np.float32))
        return len(machines) - 1

    def contest(names: list[str], marks: list[str]) -> Contest:
        out, where = Contest(names), {}
        for i, m in enumerate(marks):
            where.setdefault(m, []).append(i)
        for a in range(len(names)):
            for b in range(a + 1, len(names)):
                out.pairs.append((a, b, machine(where[names[a]], where[names[b]])))
        return out

    if len(families) < 3:
        top = contest(families, marks)
    else:
        top = Contest(families)
        for f in families:
            own, others = [i for i, m in enumerate(marks) if m == f], [i for i, m in enumerate(marks) if m != f]
            top.alone.append(machine(own, others[:: max(1, len(others) // (OTHERS * len(own)))]))
    within = [contest([x for x in known if family_of(x) == f], langs) for f in families]
    stacked = np.stack(machines, axis=1) if machines else np.zeros(((2 << bits) + 1, 0), np.float32)
    return LanguageModel(top, within, np.ascontiguousarray(stacked[:-1]), stacked[-1].astype(np.float64), bits)


def identify(docs: DataFrame, model: LanguageModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of each row; ``und`` with score 0 if the text is null or has no letter.

    Every byte of a text counts. Repeated rows come back as often as they occur; other columns are ignored.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = shared.value.predict(*binary_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "letters", "lang_pred", "score"])

    found = rows.mapInArrow(tidied(named), f"doc_id {id_type}, letters boolean, lang_pred string, score double")
    return found.select("doc_id", F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))
