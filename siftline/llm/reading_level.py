"""Problem 10: reading level of every document (a many-facet Rasch model of levels, words, sentences and teachers)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.words import SPACE, WordReader
from siftline.session import cut

LEVELS = 5
#: Judged documents that teachers, discriminations and the scale are fitted on (by hashed id).
LABELLED = 50_000
#: Word classes (script x length) and the buckets of each in which words are counted: the model's size, whatever the
#: vocabulary. Words that share a bucket share a difficulty; a bucket never mixes classes.
CLASSES, BUCKETS = 64, 16_384
#: Occurrences that a word's class counts for in its difficulty; rounds over all documents at full weight.
PRIOR, ROUNDS = 20.0, 2
#: Longest sentence told apart, and smoothing over neighbouring lengths.
LONGEST, KERNEL = 63, np.array([1, 2, 3, 2, 1.0]) / 9
#: Bands of word difficulty (in log rate a level), and the share of documents from which a word is common: the traits.
BANDS, COMMON = (-0.25, 0.12, 0.4, 0.65), 0.3
#: Weight of the priors of the discriminations and of the scale.
RIDGE, SCALE_RIDGE = 1.0, 100.0

_AT = np.arange(LEVELS) - (LEVELS - 1) / 2
_SENTENCES = re.compile(r"(?<=[.!?؟])\s+|[\n\r]+")
_FAMILIES = 2 * (len(BANDS) + 1)


def word_class(word: str) -> int:
    return (32 if word[0] >= "ء" else 0) + min(len(word), 31)


def bucket(word: str) -> int:
    return word_class(word) * BUCKETS + zlib.crc32(word.encode()) % BUCKETS


_SCRIPT = np.arange(CLASSES * BUCKETS, dtype=np.int32) // (32 * BUCKETS)
_CLASS = np.arange(CLASSES * BUCKETS, dtype=np.int32) // BUCKETS


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every text as buckets with their occurrences, and its sentences as codes of script and length."""
    reader, known = WordReader(), {}
    for batch in batches:
        rows = []
        for key, text in zip(batch["_id"].tolist(), batch["_text"]):
            own: dict[int, int] = {}
            lens, total = [], 0
            for sentence in _SENTENCES.split(text.strip()):
                words, arabic = reader.words(sentence), 0
                for w in words:
                    b = known.get(w)
                    if b is None:
                        if len(known) > 200_000:
                            known.clear()
                        b = known[w] = bucket(w)
                    own[b] = own.get(b, 0) + 1
                    arabic += b >= 32 * BUCKETS
                if words:
                    total += len(words)
                    lens.append(64 * (2 * arabic > len(words)) + min(len(words), LONGEST))
            rows.append((key, list(own), list(own.values()), lens, any(c in text for c in ".!?؟")))
        yield pd.DataFrame(rows, columns=["_id", "_at", "_times", "_lens", "_ends"])


_COUNTED = "_id string, _at array<int>, _times array<int>, _lens array<int>, _ends boolean"


def _flat(arrays: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All elements in a row, and the row each belongs to."""
    sizes = [len(a) for a in arrays]
    return (np.concatenate(arrays.tolist()) if len(sizes) else np.zeros(0)).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


class Texts:
    """A batch of counted texts: who has which word and sentence, ready for sums."""

    def __init__(self, batch: pd.DataFrame) -> None:
        self.n = len(batch)
        self.word, self.row = _flat(batch["_at"])
        self.times = _flat(batch["_times"])[0].astype(float)
        self.code, self.of = _flat(batch["_lens"])
        self.ends = batch["_ends"].to_numpy(bool)
        self.words = np.bincount(self.row, self.times, self.n) if len(self.row) else np.zeros(self.n)
        self.sentences = np.bincount(self.of, minlength=self.n)
        arabic = np.bincount(self.of, self.code >= 64, self.n) if len(self.of) else np.zeros(self.n)
        self.arabic = (2 * arabic > self.sentences).astype(float)
        told = self.ends[self.of]  # without any sentence end a text's lines say nothing of its sentences
        self.told, self.told_of = self.code[told], self.of[told]

    def sums(self, p: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Expected occurrences by level: of words (with their documents as a last column), and of sentence lengths."""
        met, inverse = np.unique(self.word, return_inverse=True)
        by_word = np.stack([np.bincount(inverse, self.times * p[self.row, k], len(met)) for k in range(LEVELS)] + [np.bincount(inverse, minlength=len(met))], 1)
        by_length = np.stack([np.bincount(self.told, p[self.told_of, k], 128) for k in range(LEVELS)] + [np.zeros(128)], 1)
        return {"w": (met, by_word), "l": (np.arange(128), by_length)}


class Model:
    """Difficulties of words and sentence lengths by level, discriminations, the teachers, and the scale."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, documents: np.ndarray, share: np.ndarray) -> None:
        """words: buckets x levels; lengths: 128 x levels; documents: of every bucket, by share the texts of each script."""
        classes = np.zeros((CLASSES, LEVELS))
        for k in range(LEVELS):
            classes[:, k] = words[:, k].reshape(CLASSES, BUCKETS).sum(1)
        mean = classes + 1e-3
        mean /= mean.sum(1, keepdims=True)
        total = np.stack([classes[:32].sum(0), classes[32:].sum(0)]) + 1
        log = np.log((words + PRIOR * mean[_CLASS]) / total[_SCRIPT])
        self.word = (log - log.mean(1, keepdims=True)).astype(np.float32)
        self.length = np.zeros((128, LEVELS))
        for s in (0, 64):
            smooth = np.stack([np.convolve(lengths[s : s + 64, k], KERNEL, "same") for k in range(LEVELS)], 1) + 0.3
            self.length[s : s + 64] = np.log(smooth / smooth.sum(0))
        self.length -= self.length.mean(1, keepdims=True)
        difficulty = self.word @ _AT / (_AT @ _AT)
        self.family = (2 * np.digitize(difficulty, BANDS) + (documents > COMMON * np.maximum(share, 1)[_SCRIPT])).astype(np.int8)
        self.power, self.easy = np.full(2, 0.4), np.zeros(LEVELS)
        self.scale: tuple[np.ndarray, ...] | None = None

    def facets(self, t: Texts) -> np.ndarray:
        """Log likelihood of the words and of the sentences of every text at every level."""
        x = np.zeros((t.n, 2, LEVELS))
        for k in range(LEVELS):
            x[:, 0, k] = np.bincount(t.row, t.times * self.word[t.word, k], t.n)
            x[:, 1, k] = np.bincount(t.told_of, self.length[t.told, k], t.n)
        return x - x.mean(2, keepdims=True)

    def traits(self, t: Texts, facets: np.ndarray) -> np.ndarray:
        """A text's place in the model's dimensions: shares of the word families, sizes, mean likelihoods by level."""
        words, sentences = np.maximum(t.words, 1), np.maximum(t.sentences, 1)
        family = np.bincount(t.row * _FAMILIES + self.family[t.word], t.times, t.n * _FAMILIES).reshape(t.n, _FAMILIES)
        sizes = [np.log(words / sentences), np.log(sentences), np.log(words), t.ends.astype(float), t.arabic]
        return np.c_[np.sqrt(family / words[:, None]), np.stack(sizes, 1), facets[:, :, : LEVELS - 1].reshape(t.n, -1) / words[:, None]]

    def by_facets(self, facets: np.ndarray) -> np.ndarray:
        return np.einsum("nfk,f->nk", facets, self.power) + self.easy

    def discriminate(self, facets: np.ndarray, told: np.ndarray) -> None:
        """Discriminations of the two facets and the levels' thresholds, by Newton steps on the judged texts; told is the
        log likelihood of their judgements at every level."""
        a, b, n = self.power, self.easy, 2
        for _ in range(60):
            z = np.einsum("nfk,f->nk", facets, a) + b
            q, y = softmax(z), softmax(z + told)
            mean = np.einsum("nfk,nk->nf", facets, q)
            own = np.einsum("nfk,ngk,nk->fg", facets, facets, q) - mean.T @ mean
            mixed = np.einsum("nfk,nk->fk", facets, q) - np.einsum("nf,nk->fk", mean, q)
            hessian = np.block([[own, mixed], [mixed.T, np.diag(q.sum(0)) - q.T @ q]]) + np.eye(n + LEVELS) * RIDGE
            step = np.linalg.solve(hessian, np.r_[np.einsum("nfk,nk->f", facets, y - q) - RIDGE * (a - 0.4), (y - q).sum(0) - RIDGE * b])
            a, b = a + step[:n], b + step[n:]
            if np.abs(step).max() < 1e-4:
                break
        self.power, self.easy = a, b

    @staticmethod
    def _squares(x: np.ndarray) -> np.ndarray:
        i, j = np.triu_indices(x.shape[1])
        return x[:, i] * x[:, j]

    def set_scale(self, traits: np.ndarray, told: np.ndarray) -> None:
        """The levels' regions in the traits' space (quadratic borders), by bounded Newton steps on the judged texts."""
        mean, sd = traits.mean(0), traits.std(0) + 1e-9
        x = np.clip((traits - mean) / sd, -4, 4).astype(np.float32)
        square = self._squares(x)
        mean2, sd2 = square.mean(0), square.std(0) + 1e-6
        a = np.c_[x, (square - mean2) / sd2, np.ones(len(x), np.float32)]
        b = np.zeros((a.shape[1], LEVELS), np.float32)
        inverse = np.linalg.inv((a.T @ a).astype(float) / 2 + np.eye(a.shape[1]) * SCALE_RIDGE).astype(np.float32)
        for _ in range(150):
            q = softmax(a @ b)
            y = softmax(np.log(q + 1e-12) + told)
            b = b + inverse @ (a.T @ (y - q).astype(np.float32) - np.float32(SCALE_RIDGE) * b)
        self.scale = mean, sd, mean2, sd2, b

    def by_scale(self, traits: np.ndarray) -> np.ndarray:
        mean, sd, mean2, sd2, b = self.scale
        x = np.clip((traits - mean) / sd, -4, 4).astype(np.float32)
        return np.c_[x, (self._squares(x) - mean2) / sd2, np.ones(len(x), np.float32)] @ b


def teachers(told: list[list[tuple[int, int]]], p: np.ndarray, count: int) -> np.ndarray:
    """Of every teacher the chance of each judgement at each level (teacher x level x judgement), from the levels so far;
    eight right judgements beforehand, so a teacher with few counts as mostly right."""
    chances = np.full((count, LEVELS, LEVELS), 0.3) + np.eye(LEVELS) * 8
    for row, marks in enumerate(told):
        for g, level in marks:
            chances[g, :, level] += p[row]
    return chances / chances.sum(2, keepdims=True)


def told_log(told: list[list[tuple[int, int]]], chances: np.ndarray) -> np.ndarray:
    """Log likelihood of every text's judgements at every level; zeros where there is none."""
    out = np.zeros((len(told), LEVELS))
    log = np.log(chances)
    for row, marks in enumerate(told):
        for g, level in marks:
            out[row] += log[g, :, level]
    return out


def _marks(column: pd.Series) -> list[list[tuple[int, int]]]:
    """Judgements of a text, packed as teacher * LEVELS + level."""
    return [[] if m is None else [divmod(int(x), LEVELS) for x in m] for m in column]


def labelled(labels: DataFrame, key: str = "doc_id", level: str = "level", grader: str = "grader_code") -> DataFrame:
    """(_id, _grader, _level): judgements, repeated ones of a teacher once, unusable ones left out. Judgements without a
    teacher count as one teacher's."""
    fit = labels.where(F.col(key).isNotNull() & F.col(level).between(1, LEVELS))
    return fit.select(
        F.col(key).cast("string").alias("_id"), F.coalesce(F.col(grader).cast("string"), F.lit("")).alias("_grader"), (F.col(level) - 1).cast("int").alias("_level")
    ).distinct()


def _packed(sums: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    for kind, (at, values) in sums.items():
        kept = np.flatnonzero(values.any(1))
        yield pd.DataFrame({"_kind": kind, "_at": at[kept].astype(np.int32)} | {f"_c{k}": values[kept, k] for k in range(LEVELS + 1)})


def _added(old: dict, new: dict) -> dict:
    """Sums of two batches; words by bucket, so a task holds at most the model's size."""
    out = {"l": (new["l"][0], old["l"][1] + new["l"][1])} if old else {"l": new["l"]}
    if not old:
        return out | {"w": new["w"]}
    at = np.r_[old["w"][0], new["w"][0]]
    met, inverse = np.unique(at, return_inverse=True)
    values = np.r_[old["w"][1], new["w"][1]]
    return out | {"w": (met, np.stack([np.bincount(inverse, values[:, k], len(met)) for k in range(LEVELS + 1)], 1))}


_SUMS = "_kind string, _at int, " + ", ".join(f"_c{k} double" for k in range(LEVELS + 1))


def levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", field: str = "text", rounds: int = ROUNDS, limit: int = LABELLED) -> DataFrame:
    """(key, level, difficulty): every document whose text isn't null, empty or blank, with its level from 1 to 5 and
    its expected level.

    A many-facet Rasch model. A document of level k holds every word at the word's own rate for k: its base and its
    difficulty (words of few occurrences lean on their class of script and length), and sentences of every length at a
    rate of their own; a teacher names level j for a document of level k with a chance of their own. Alternating
    optimisation: given the levels so far, difficulties are sums over documents, which tasks hand on by bucket; given
    the difficulties, every document has chances of its levels. The first levels are the teachers'; then every
    document, judged or not, counts with its chances at full weight. A round is one pass over the documents, whose words
    are counted once and kept in the shared folder as buckets (CLASSES x BUCKETS in all, so that the model has a fixed
    size and every word of the corpus a difficulty; it is broadcast).

    Two facets (words, sentences) get discriminations, and at the end the levels get their regions in the space of the
    model's traits: shares of words by band of difficulty, sizes, mean likelihoods. Both are fitted on at most limit
    judged documents, chosen by hashed id, of which 23 numbers each come to the driver. A judged document's own
    judgements count for its level like any evidence, by what their teachers' word is worth.

    Without any judgement every document gets the middle level. Repeated keys each keep their row; a text without words
    is judged by its traits alone.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    texts = documents.select(F.col(key).cast("string").alias("_id"), F.col(field).alias("_text")).where(F.col("_text").rlike(f"[^{SPACE}]"))
    counted = texts.mapInPandas(_counted, _COUNTED)
    marks = labelled(labels)
    chosen = marks.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(limit)
    fitted_on = cut(marks.join(F.broadcast(chosen), "_id"))
    graders = {g: i for i, g in enumerate(sorted(r[0] for r in fitted_on.select("_grader").distinct().collect()))}
    if not graders:
        middle = (LEVELS + 1) // 2
        return texts.select(F.col("_id").cast(kind).alias(key), F.lit(middle).alias("level"), F.lit(float(middle)).alias("difficulty"))
    # the teachers of the fit are known by number; another one's judgements say nothing yet
    numbers = F.broadcast(spark.createDataFrame(list(graders.items()), "_grader string, _g int"))
    packed = marks.join(numbers, "_grader").groupBy("_id").agg(F.sort_array(F.collect_list(F.col("_g") * LEVELS + F.col("_level"))).alias("_marks"))
    in_fit = packed.join(F.broadcast(chosen.withColumn("_fit", F.lit(True))), "_id", "left")
    indexed = cut(counted.join(in_fit, "_id", "left").withColumn("_fit", F.coalesce("_fit", F.lit(False))))
    judged = cut(indexed.where("_fit"))

    def total(source: DataFrame, shared) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts by level over all texts of the source, under a model or, without one, as the teachers say."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, chances = shared.value
            sums: dict = {}
            scripts = np.zeros(2)
            for batch in batches:
                if len(batch):
                    t = Texts(batch)
                    z = told_log(_marks(batch["_marks"]), chances)
                    p = softmax(z if model is None else z + model.by_facets(model.facets(t)))
                    sums = _added(sums, t.sums(p))
                    scripts += [(t.arabic == 0).sum(), t.arabic.sum()]
            if sums:
                yield from _packed(sums | {"s": (np.arange(2), np.c_[scripts, np.zeros((2, LEVELS))])})

        rows = source.mapInPandas(run, _SUMS).groupBy("_kind", "_at").agg(*[F.sum(f"_c{k}").alias(f"_c{k}") for k in range(LEVELS + 1)]).toPandas()
        words, lengths, scripts, seen = np.zeros((CLASSES * BUCKETS, LEVELS)), np.zeros((128, LEVELS)), np.zeros(2), np.zeros(CLASSES * BUCKETS)
        for what, part in rows.groupby("_kind"):
            at, values = part["_at"].to_numpy(int), part[[f"_c{k}" for k in range(LEVELS + 1)]].to_numpy(float)
            if what == "w":
                words[at], seen[at] = values[:, :LEVELS], values[:, LEVELS]
            elif what == "l":
                lengths[at] = values[:, :LEVELS]
            else:
                scripts[at] = values[:, 0]
        return words, lengths, seen, scripts

    def placed(model: Model) -> tuple[np.ndarray, np.ndarray, list]:
        """Facets, traits and judgements of the judged texts, in the order of their ids."""
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    t = Texts(batch)
                    x = shared.value.facets(t)
                    yield pd.DataFrame({"_id": batch["_id"], "_x": list(x.reshape(t.n, -1)), "_t": list(shared.value.traits(t, x)), "_marks": batch["_marks"]})

        rows = judged.mapInPandas(run, "_id string, _x array<double>, _t array<double>, _marks array<int>").toPandas()
        rows = rows.assign(_first=[tuple(x) for x in rows["_x"]]).sort_values(["_id", "_first"], kind="stable")
        facets = np.vstack(rows["_x"].tolist()) if len(rows) else np.zeros((0, 2 * LEVELS))
        return facets.reshape(len(rows), 2, LEVELS), np.vstack(rows["_t"].tolist()) if len(rows) else np.zeros((0, 1)), _marks(rows["_marks"])

    start = np.full((len(graders), LEVELS, LEVELS), 0.015) + np.eye(LEVELS) * 0.9
    chances = start / start.sum(2, keepdims=True)
    model = Model(*total(judged, spark.sparkContext.broadcast((None, chances))))
    for n in range(rounds + 1):
        facets, traits, told = placed(model)
        if not len(facets):
            break
        model.discriminate(facets, told_log(told, chances))
        chances = teachers(told, softmax(model.by_facets(facets) + told_log(told, chances)), len(graders))
        if n < rounds:
            power, easy = model.power, model.easy
            model = Model(*total(indexed, spark.sparkContext.broadcast((model, chances))))
            model.power, model.easy = power, easy
        else:
            model.set_scale(traits, told_log(told, chances))
    shared = spark.sparkContext.broadcast((model, chances))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, chances = shared.value
        for batch in batches:
            if len(batch):
                t = Texts(batch)
                x = model.facets(t)
                z = model.by_facets(x) if model.scale is None else model.by_scale(model.traits(t, x))
                p = softmax(z + told_log(_marks(batch["_marks"]), chances))
                yield pd.DataFrame({"_id": batch["_id"], "level": p.argmax(1).astype(np.int32) + 1, "difficulty": p @ np.arange(1, LEVELS + 1)})

    told = indexed.mapInPandas(judge, "_id string, level int, difficulty double")
    return told.select(F.col("_id").cast(kind).alias(key), "level", "difficulty")
