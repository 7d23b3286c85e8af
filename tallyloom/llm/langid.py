"""Language identification by multilingual mixture inference.

Each language has a smoothed distribution over hashed character trigrams of lower-cased words (runs of letters, with their
ends). A document's trigrams are taken as drawn from a mixture of languages: expectation-maximisation estimates the proportions, and the
languages are chosen by penalised likelihood: the best k languages are fitted on their own, for k = 1, 2 and on, as long as
log-likelihood - penalty * k * ln(trigrams) grows. The largest share of the chosen set is the prediction.

Counts cover every labelled row that the caller hands over: they are summed in tasks, then by a shuffle, to languages x BUCKETS
numbers, whatever the corpus; that bound is what makes the model fit for every task (a language costs 0.5 MB).

A text that is null or has no letter is `und` with score 0, as is everything if nothing was learned. Rows with a null language or a null
text teach nothing. Null ids and repeated rows come out as they came in; an empty table gives an empty one. Long texts are read in slices, whole, and inferred
in groups of bounded size, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ready

BITS = 15
BUCKETS = 1 << BITS
_SLICE = 1 << 20
#: Different trigrams of the texts that are inferred together, at most, besides those of one text more.
_GROUP = 1 << 17
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter, as a table."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of a text, and their counts."""
    total = None
    for at in range(0, len(text or ""), _SLICE):
        c = np.frombuffer(text[max(0, at - 2) : at + _SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_letters()[c], c, np.uint32(0))
        if not c.any():
            continue
        ends = [np.zeros(1, np.uint32)] if not at else []
        c = np.concatenate((*ends, c, np.zeros(1, np.uint32)) if at + _SLICE >= len(text) else (*ends, c)).astype(np.uint64)
        a, b, d = c[:-2], c[1:-1], c[2:]
        h = (a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F) ^ d * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)
        n = np.bincount(h[b != 0].astype(np.int64), minlength=BUCKETS)
        total = n if total is None else total + n
    if total is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    where = np.flatnonzero(total)
    return where, total[where]


def train(labelled: DataFrame) -> dict[str, np.ndarray]:
    """labelled(text, lang): log-probabilities of the buckets, by language."""
    ready(labelled.sparkSession)

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                where, n = features(text.as_py())
                if len(where):
                    counts.setdefault(lang, np.zeros(BUCKETS, np.int64))[where] += n
        for lang, n in counts.items():
            where = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(where, pa.int32()), pa.array(n[where])], ["lang", "bucket", "n"])

    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model: dict[str, np.ndarray] = {}
    for lang, buckets, n in sums.groupBy("lang").agg(F.collect_list("bucket"), F.collect_list("n")).toLocalIterator():
        model[lang] = np.full(BUCKETS, 0.1)
        model[lang][buckets] += n
    return {lang: np.log(v / v.sum()).astype(np.float32) for lang, v in sorted(model.items())}


def mixture(log_p: np.ndarray, n: np.ndarray, ends: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for several documents at once: (proportions, log-likelihoods).

    log_p: languages x trigrams of all documents, n: their counts, ends: where each document begins, allowed: documents x languages.
    """
    lengths = np.diff(np.append(ends, log_p.shape[1]))
    peak = log_p.max(0)
    p = np.exp(log_p - peak)
    share = allowed / allowed.sum(1, keepdims=True)
    total = np.add.reduceat(n, ends)
    for _ in range(rounds):
        r = p * np.repeat(share, lengths, axis=0).T
        r *= n / r.sum(0)
        share = np.add.reduceat(r, ends, axis=1).T / total[:, None]
    mixed = (p * np.repeat(share, lengths, axis=0).T).sum(0)
    return share, np.add.reduceat(n * (np.log(np.maximum(mixed, 1e-300)) + peak), ends)


def infer(texts: list[str | None], log_p: np.ndarray, most: int | None = None, penalty: float = 4.0, rounds: int = 12) -> list[tuple[int, float, list[int]]]:
    """(language, score, chosen set) of each text; language -1 where there is none. The score is the language's share among all. most: no larger sets than that."""
    out: list[tuple[int, float, list[int]]] = [(-1, 0.0, [])] * len(texts)
    if not len(log_p):
        return out
    group, held = [], 0
    for i, text in enumerate(texts):
        where, n = features(text)
        if len(where):
            group.append((i, where, n))
            held += len(where)
        if group and (held > _GROUP or i + 1 == len(texts)):
            _infer_group(group, log_p, len(log_p) if most is None else min(most, len(log_p)), penalty, rounds, out)
            group, held = [], 0
    return out


def _infer_group(group, log_p, most, penalty, rounds, out) -> None:
    n = np.concatenate([x for _, _, x in group]).astype(np.float64)
    lengths = np.array([len(w) for _, w, _ in group])
    ends = np.cumsum(lengths) - lengths
    part = log_p[:, np.concatenate([w for _, w, _ in group])].astype(np.float64)
    share, _ = mixture(part, n, ends, np.ones((len(group), len(log_p))), rounds)
    order, size = np.argsort(-share, axis=1, kind="stable"), np.log(np.add.reduceat(n, ends) + 1)
    best, value, chosen = np.zeros(len(group), np.int64), np.full(len(group), -np.inf), np.zeros(share.shape)
    going = np.arange(len(group))
    for k in range(1, most + 1):
        # Only texts for which the last language paid try one more.
        inside = np.repeat(np.isin(np.arange(len(group)), going), lengths)
        sub, own = (part, n) if inside.all() else (part[:, inside], n[inside])
        allowed = np.zeros((len(going), len(log_p)))
        np.put_along_axis(allowed, order[going, :k], 1.0, axis=1)
        fitted, fit = mixture(sub, own, np.cumsum(lengths[going]) - lengths[going], allowed, 1 if k == 1 else rounds)
        fit = fit - penalty * k * size[going]
        better = fit > value[going]
        going, fit, fitted = going[better], fit[better], fitted[better]
        best[going], value[going], chosen[going] = k, fit, fitted
        if not len(going):
            break
    for j, (i, _, _) in enumerate(group):
        top = int(np.argmax(chosen[j]))
        out[i] = (top, float(min(1.0, share[j, top])), sorted(order[j, : best[j]].tolist()))


def identify(docs: DataFrame, model: dict[str, np.ndarray], most: int | None = None, penalty: float = 4.0) -> DataFrame:
    """docs with lang_pred, score and languages (the chosen set, joined by commas) added; columns of those names are replaced."""
    ready(docs.sparkSession)
    names, log_p = list(model), np.array(list(model.values()), np.float32)
    held = docs.sparkSession.sparkContext.broadcast((names, log_p))
    new = ("lang_pred", "score", "languages")
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    at = docs.columns.index("text")

    def run(batches):
        names, log_p = held.value
        for b in batches:
            found = infer(b.column(at).cast(pa.string()).to_pylist(), log_p, most, penalty)
            cols = [pa.array([names[k] if k >= 0 else "und" for k, _, _ in found], pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array([",".join(names[x] for x in c) for _, _, c in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *new])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()).add("languages", StringType())
    return docs.mapInArrow(run, schema)


def fold(doc_id="doc_id", folds: int = 5):
    """crc32 of doc_id as text, mod folds; null for a null id, whose row neither teaches nor is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def train_on_folds(docs: DataFrame) -> dict[str, np.ndarray]:
    return train(docs.where(fold() != 0).select("text", "lang"))
