"""Language identification with string kernels.

Kernel: the blended spectrum presence kernel. A text is the set of its character n-grams for n = 1 to 3 (lower-cased,
everything but letters is one space); k(x, y) is the number of shared n-grams over the root of the product of the
sets' sizes. N-grams are hashed to 2^18 buckets, and the sets are seen through the buckets of the landmarks.

Model: Nystroem landmarks and one-versus-rest kernel ridge regression. With landmark kernel matrix W and the training rows' kernel
matrix C, the coefficients solve (C'C + lambda n W) A = C'Y. Scoring a batch is one matrix product for the kernel
values and one for the class scores.

Fit: the cover of a word (what stands between white space) is the share of its 3-grams, by position, that the landmarks hold, and the cover of
a text the median of its words', so that a key or a name, however many letters and digits it mixes, spoils no short text. A text of fewer than three characters goes by its longest n-grams.
A language's cut is COVER of the cover that all but 1 % of its training rows reach, each landmark measured against the others. A text
under the cut of its best language fits none of them: its score is brought below MIN_SCORE, down to 0 for a text without a known n-gram.

The model is fitted on a bounded sample: at most PER_LANG labelled training rows of each language and LANDMARKS
landmarks among them (more languages than MOST_ROWS / PER_LANG share MOST_ROWS rows), drawn by a hash of id and text. The driver solves
for the coefficients from the rows' kernel values, which the tasks compute. Training rows have a non-null text and lang, and crc32 of the id as text is not 0
modulo 5. A prediction uses the text alone.

Cases: a null text, or one without a letter, is `und` with score 0; so is every text if no row can be learned from; a null id
is held out; repeated rows get equal predictions; an empty table gives an empty result. Long texts are read whole, as one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import chunks_by_bytes, discard, for_texts, held_out, materialize, slices

ORDERS = 3
BUCKETS = 18
PER_LANG = 300
LANDMARKS = 96
RIDGE = 1e-4
#: Training rows in all, and landmarks, where there are very many languages.
MOST_ROWS, MOST_LANDMARKS = 600_000, 256
#: A text may have so much less of its n-grams known than the training rows of its language.
COVER = 0.75
#: The pipeline rejects a document whose score is below this: one that fits none of the learned languages.
MIN_SCORE = 0.2
UND = "und"

_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


_spaces: list[np.ndarray] = []


def spaces() -> np.ndarray:
    """Whether each code point ends a word: white space, and 0."""
    if not _spaces:
        _spaces.append(np.fromiter((c == 0 or chr(c).isspace() for c in range(0x110000)), bool, 0x110000))
    return _spaces[0]


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, non-letters collapsed to one space and 0 between texts; the text of each; letters in each text; the word of each."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])
    letter = letters()[codes]
    n_letters = np.bincount(owner[letter], minlength=len(texts))
    ends = np.cumsum([len(t) + 1 for t in lower]) - 1
    word = np.cumsum(spaces()[codes])
    codes = np.where(letter, codes, np.uint32(32))
    codes[ends] = 0
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep], owner[keep], n_letters, word[keep]


def buckets(codes: np.ndarray) -> list[np.ndarray]:
    """The bucket of the n-gram at each position, n = 1 to ORDERS; 0 stands for n-grams over the end of a text."""
    out = []
    zero = np.flatnonzero(codes == 0)
    acc = np.zeros(len(codes), np.uint32)
    for n in range(ORDERS):
        acc = acc[: len(codes) - n] * np.uint32(31) + codes[n:] * _MUL[n]
        mixed = acc ^ (acc >> np.uint32(15))
        b = ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKETS)).astype(np.int32)
        b[b == 0] = 1
        for back in range(n + 1):
            at = zero - back
            b[at[(at >= 0) & (at < len(b))]] = 0
        out.append(b)
    return out


def presence(texts: list[str], table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[text, column] presence of the columns' n-grams, the letters in each text, and its cover. Column 0 is for n-grams outside."""
    codes, owner, n_letters, word = encode(texts)
    seen = np.zeros((len(texts), width), bool)
    flat = seen.reshape(-1)
    cover = np.zeros(len(texts))
    for b in buckets(codes):
        column = table[b]
        flat[owner[: len(b)] * width + column] = True
        whole = np.bincount(owner[: len(b)][b > 0], minlength=len(texts))
        known = np.bincount(owner[: len(b)][column > 0], minlength=len(texts))
        cover = np.where(whole > 0, known / np.maximum(whole, 1), cover)
    seen[:, 0] = False
    at = np.flatnonzero((b > 0) & (codes[1 : len(b) + 1] != 32))  # an n-gram belongs to the word of its second character
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], np.diff(word[at + 1]) != 0]))
        share = np.add.reduceat(column[at] > 0, first, dtype=np.int64) / np.diff(np.append(first, len(at)))
        of = owner[at[first]]
        share = share[np.lexsort((share, of))]
        n = np.bincount(of, minlength=len(texts))
        some = np.flatnonzero(n)
        cover[some] = share[(np.cumsum(n) - n + n // 2)[some]]
    return seen, n_letters, cover


class Landmarks:
    """The n-grams of the landmark texts as columns, and what a text has of them."""

    def __init__(self, marks: list[np.ndarray]):
        """marks: the buckets of each landmark's n-grams."""
        used = np.zeros(1 << BUCKETS, np.int32)
        for b in marks:
            used[b] += 1
        used[0] = 0
        self.table = np.zeros(1 << BUCKETS, np.int32)
        self.table[used > 0] = np.arange(1, int((used > 0).sum()) + 1)
        self.shared = np.where(used > 1, self.table, 0).astype(np.int32)  # n-grams of two landmarks
        self.width = int((used > 0).sum()) + 1
        self.marks = np.zeros((len(marks), self.width), np.uint8)
        for row, b in zip(self.marks, marks):
            row[self.table[b]] = 1
        self.marks[:, 0] = 0
        self.roots = np.sqrt(self.marks.sum(axis=1, dtype=np.float32))

    def kernel(self, seen: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_dense"):
            self._dense = np.ascontiguousarray(self.marks.astype(np.float32).T)
        x = seen.astype(np.float32)
        shared = x @ self._dense
        root = np.sqrt(x.sum(axis=1))[:, None] * self.roots[None, :]
        return shared / np.maximum(root, 1e-9)

    def see(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kernel values, letters and cover of each text."""
        seen, n_letters, cover = presence(texts, self.table, self.width)
        return self.kernel(seen), n_letters, cover

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_dense"}


def text_buckets(text: str) -> np.ndarray:
    """The distinct buckets of a text's n-grams: 2^BUCKETS at most, however long the text."""
    return np.unique(np.concatenate(buckets(encode([text])[0])))


class Model:
    def __init__(self, landmarks: Landmarks | None, langs: list[str], kernel: np.ndarray, cover: np.ndarray, ridge: float = RIDGE):
        """langs, kernel, cover: of the training rows."""
        self.langs = sorted(set(langs))
        if landmarks is None or not self.langs:
            self.langs = []
            return
        self.landmarks = landmarks
        of = np.searchsorted(self.langs, langs)
        n_of = np.bincount(of, minlength=len(self.langs))
        self.cut = np.array([COVER * np.quantile(cover[of == k], 0.01) for k in range(len(self.langs))])
        y = np.full((len(of), len(self.langs)), -1.0)
        y[np.arange(len(of)), of] = 1.0
        c, w = kernel.astype(np.float64), landmarks.kernel(landmarks.marks).astype(np.float64)
        weight = (len(of) / len(self.langs) / n_of[of])[:, None]  # languages weigh the same
        left = c.T @ (weight * c) + ridge * len(of) * w + 1e-8 * np.eye(len(w))
        self.coef = np.linalg.solve(left, c.T @ (weight * y)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UND] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return lang, score
        whole = [t or "" for t in texts]
        ranges = [(k, min(j, k + 256)) for i, j in chunks_by_bytes([len(t) for t in whole], 1 << 20) for k in range(i, j, 256)]
        for i, j in ranges:
            kernel, n_letters, cover = self.landmarks.see(whole[i:j])
            f = kernel @ self.coef
            best = f.argmax(axis=1)
            top = np.clip((f.max(axis=1).astype(np.float64) + 1) / 2, 0, 1)
            cut = self.cut[best]
            top = np.where(cover < cut, top * MIN_SCORE * cover / np.maximum(cut, 1e-9), top)
            for k in np.flatnonzero(n_letters):
                lang[i + k], score[i + k] = self.langs[best[k]], float(top[k])
        return lang, score


def from_texts(rows: list[tuple[str, str]], landmarks: int = LANDMARKS) -> Model:
    """A model of (lang, text) rows in hand, in a random order."""
    rows = [r for r in rows if any(map(str.isalpha, r[1]))]
    if not rows:
        return Model(None, [], np.zeros((0, 0)), np.zeros(0))
    at = choose([lang for lang, _ in rows], landmarks)
    marks = Landmarks([text_buckets(rows[k][1]) for k in at])
    kernel, _, cover = marks.see([t for _, t in rows])
    cover[at] = presence([rows[k][1] for k in at], marks.shared, marks.width)[2]
    return Model(marks, [lang for lang, _ in rows], kernel, cover)


def choose(langs: list[str], landmarks: int) -> list[int]:
    """The first rows of each language, as many of each; of some languages alone where there are more languages than landmarks."""
    n = len(set(langs))
    landmarks = max(landmarks, min(2 * n, MOST_LANDMARKS))
    each = max(1, landmarks // n)
    count: dict[str, int] = {}
    at = []
    for k, lang in enumerate(langs):
        count[lang] = count.get(lang, 0) + 1
        if count[lang] <= each and len(at) < landmarks:
            at.append(k)
    return at


def fit(docs: DataFrame, per_lang: int = PER_LANG, seed: int = 3, landmarks: int = LANDMARKS) -> Model:
    """A model from at most per_lang training rows of each language, fewer where there are very many languages.

    The drawn rows stay in a written table. The driver gets the n-gram sets of the landmarks (2^BUCKETS numbers each at most) and
    one kernel row for each training row, never a text.
    """
    spark = docs.sparkSession
    train = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(5) & F.col("text").rlike(r"\p{L}"))
    row = F.xxhash64(F.lit(seed), "doc_id", "text")  # rows that share an id, or a text, are drawn apart
    counts = train.groupBy("lang").agg(F.approx_count_distinct(row, 0.05).alias("n")).collect()  # one row for each language
    if not counts:
        return from_texts([])
    per_lang = max(2, min(per_lang, MOST_ROWS // len(counts)))
    # a share of each language's rows by the hash: about 1.5 x per_lang distinct rows, so nothing is sorted
    share = spark.createDataFrame([(r.lang, min(1.0, 1.5 * per_lang / max(1, r.n))) for r in counts], "lang string, share double")
    drawn = train.select("lang", "text", row.alias("row")).join(F.broadcast(share), "lang").where(F.pmod("row", F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    drawn = materialize(drawn.select("lang", "row", "text"), "lang-drawn")
    keys = sorted((_rank(r.row), r.lang, r.row) for r in drawn.select("lang", "row").distinct().collect())
    count: dict[str, int] = {}
    use = []
    for _, lang, key in keys:
        count[lang] = count.get(lang, 0) + 1
        if count[lang] <= per_lang:
            use.append((lang, key))
    at = choose([lang for lang, _ in use], landmarks)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in zip(b.column("row"), b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int64()), pa.array([text_buckets(text.as_py())], pa.list_(pa.int32()))], ["row", "buckets"])

    marked = {use[k][1] for k in at}
    sets_of = {r.row: np.array(r.buckets, np.int32) for r in drawn.where(F.col("row").isin(list(marked))).mapInArrow(sets, "row long, buckets array<int>").collect()}  # a row for each landmark and its copies
    marks = Landmarks([sets_of[use[k][1]] for k in at])
    shared = spark.sparkContext.broadcast(marks)

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in slices(b.column("text"), 1 << 20):
                kernel, _, cover = shared.value.see(texts)
                other = presence(texts, shared.value.shared, shared.value.width)[2]
                yield pa.RecordBatch.from_arrays([b.column("lang")[i:j], b.column("row")[i:j], pa.array(list(kernel), pa.list_(pa.float32())), pa.array(cover), pa.array(other)], ["lang", "row", "kernel", "cover", "shared"])

    seen = {(r.lang, r.row): r for r in drawn.dropDuplicates(["lang", "row"]).mapInArrow(see, "lang string, row long, kernel array<float>, cover double, shared double").collect()}
    shared.destroy()
    discard(drawn)
    rows = [seen[k] for k in use]
    cover = np.array([r.shared if r.row in marked else r.cover for r in rows])
    return Model(marks, [r.lang for r in rows], np.array([r.kernel for r in rows], np.float32), cover)


def _rank(row: int) -> int:
    return row % (1 << 30)


def predict_column(model: Model, column: pa.Array) -> tuple[list[str], list[float]]:
    lang: list[str] = []
    score: list[float] = []
    for _, _, texts in slices(column, 1 << 20):
        a, b = model.predict(texts)
        lang += a
        score += b
    return lang, score


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    for_texts(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # MOST_LANDMARKS sets of 2^BUCKETS n-grams at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = predict_column(shared.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select("doc_id", held_out(5).alias("held_out"), "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """docs with all its columns, without the rows that are `und` or whose best score is below min_score."""
    for_texts(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # MOST_LANDMARKS sets of 2^BUCKETS n-grams at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = predict_column(shared.value, b.column("text"))
            yield b.filter(pa.array([x != UND and s >= min_score for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
