"""Mixing by raking: token weights that meet source, language and topic shares, then a sample.

Tokens are summed by cell (source, language, topic) in Spark. Only the cells that occur go to the driver,
a number each (MAX_CELLS is checked before), and the raking is a few array operations on them. Values the
caller does not name share one cell. Each document then gets the probability of its cell, and a hash of
its id decides.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.operators.joins import DEFAULT_BROADCAST_ROWS

from .common import cut, free_prefix, word_count

OTHER = "(other)"
# Cells that occur: what the driver holds, some numbers for each. More of them are refused.
MAX_CELLS = 4_000_000
ROUNDS, TOLERANCE = 500, 1e-10
# A margin further off than this after all rounds is reported.
REPORTED = 1e-4
# Share of the raked tokens that may be lost because no document is taken twice.
LOST = 0.01


def form_topic(text: Column, words: Column) -> Column:
    """A topic told from a text's form: tables, symbol noise, or prose by length in words."""
    return (F.when(F.coalesce(text.contains(" | "), F.lit(False)), "table")
            .when(F.coalesce(text.rlike(r"[#$%&*]{3}"), F.lit(False)), "symbols")
            .when(words < 100, "brief").when(words < 1000, "article").otherwise("long"))


def tempered_shares(tokens: Mapping[str, float], power: float) -> dict[str, float]:
    """Token shares raised to ``power``: 1 keeps them, below 1 evens them out, 0 makes them equal.
    Values without tokens get none."""
    weights = {k: float(n) ** power for k, n in tokens.items() if n > 0}
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()}


def rake(tokens: np.ndarray, shares: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Iterative proportional fitting of an array to the shares along each axis; see ``rake_cells``."""
    places = np.nonzero(tokens)
    weights = np.zeros(tokens.shape)
    weights[places] = rake_cells(tokens[places].astype("f8"), list(places), shares, rounds, tolerance)[0]
    return weights


def rake_cells(tokens: np.ndarray, places: list[np.ndarray], shares: list[np.ndarray], rounds: int = ROUNDS,
               tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Weights of cells that sum to one, and the largest gap left between a margin and its share.

    ``places`` gives each cell's place along each axis. Shares of values without tokens are spread over the
    others in proportion. Ends when all margins hold to ``tolerance`` or after ``rounds``. All weights are
    zero if there are no tokens.
    """
    total = tokens.sum()
    if not total > 0:
        return np.zeros(len(tokens)), 0.0
    weights = tokens / total
    goals = []
    for place, share in zip(places, shares):
        margin = np.bincount(place, weights, len(share))
        goal = np.where(margin > 0, share, 0.0)
        goals.append(goal / goal.sum() if goal.sum() > 0 else margin)
    for _ in range(rounds + 1):
        gap = max(float(np.abs(np.bincount(p, weights, len(g)) - g).max()) for p, g in zip(places, goals))
        if gap <= tolerance or _ == rounds:
            break
        for place, goal in zip(places, goals):
            margin = np.bincount(place, weights, len(goal))
            weights = weights * np.divide(goal, margin, out=np.zeros_like(goal), where=margin > 0)[place]
    return weights, gap


def probabilities(tokens: np.ndarray, raked: np.ndarray, lost: float = LOST) -> np.ndarray:
    """Probability of a token of each cell: as large as can be with at most ``lost`` of the raked mass
    cut off because a probability cannot exceed one."""
    ratio = np.divide(raked, tokens, out=np.zeros_like(raked), where=tokens > 0)
    if not ratio.any():
        return ratio
    low, high = 1 / ratio.max(), 1 / ratio[ratio > 0].min()
    for _ in range(200):
        middle = (low + high) / 2
        kept = (tokens * np.minimum(1.0, middle * ratio)).sum() / middle
        low, high = (middle, high) if kept >= (1 - lost) * raked.sum() else (low, middle)
    return np.minimum(1.0, low * ratio)


def chance(id_col: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the id (from the text where that is null): the same in every run."""
    key = F.coalesce(id_col.cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** 13))


def mix(docs: DataFrame, languages: Mapping[str, float] | float, topics: Mapping[str, float] | float,
        sources: Mapping[str, float] | float = 0.7, other: float = 0.02, seed: int = 42,
        lost: float = LOST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        source_col: str = "source") -> DataFrame:
    """``docs`` with _topic, _tokens, _weight, _probability and _sampled; nothing is shuffled but sums.

    ``languages``, ``topics`` and ``sources`` give shares; each may be a power instead, then shares are
    the documents' own, tempered. Values not named, and nulls, have the share ``other`` together.
    ``_weight`` is the raked weight of a token (one on average), ``_probability`` the calibrated
    probability. Documents without words weigh nothing in the raking and have the probability of
    their cell, or zero where the cell has no words at all. Repeated rows have the same chance. Margins
    that cannot be met together are reported by a warning that names the gap. Where a column of ``docs``
    begins with an underscore, the added columns begin with more of them.
    """
    return _mixed(docs, languages, topics, sources, other, seed, lost, id_col, text_col, lang_col, source_col)[0]


def keep_sampled(docs: DataFrame, *shares, **options) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, with their columns as they are."""
    rows, own = _mixed(docs, *shares, **options)
    return rows.filter(F.col(f"{own}sampled")).select(*docs.columns)


def _mixed(docs: DataFrame, languages, topics, sources=0.7, other: float = 0.02, seed: int = 42, lost: float = LOST,
           id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, str]:
    own = free_prefix(docs)
    keys, folds = [own + k for k in ("source_key", "lang_key", "topic")], [own + k for k in ("s", "l", "t")]
    words, weight, probability = own + "tokens", own + "weight", own + "probability"
    keyed = docs.withColumns({keys[0]: F.col(source_col).cast("string"), keys[1]: F.col(lang_col).cast("string"),
                              words: word_count(F.col(text_col))})
    keyed = keyed.withColumn(keys[2], form_topic(F.col(text_col), F.col(words)))
    summed = cut(keyed.groupBy(*keys).agg(F.sum(words).alias(words)))
    occurring = summed.count()
    if occurring > MAX_CELLS:
        raise ValueError(f"{occurring} cells of source, language and topic; at most {MAX_CELLS} can be raked")
    cells = summed.collect()
    named = []
    for k, wanted in zip(keys, (sources, languages, topics)):
        if isinstance(wanted, float | int):
            sums: dict[str, float] = {}
            for r in cells:
                if r[k] is not None:
                    sums[r[k]] = sums.get(r[k], 0) + r[words]
            wanted = tempered_shares(sums, float(wanted))
        named.append(dict(wanted))
    index = [{v: i for i, v in enumerate([*n, None])} for n in named]
    places = [np.array([at.get(r[k], len(at) - 1) for r in cells], "i8") for at, k in zip(index, keys)]
    shares = [np.array([*n.values(), other], "f8") for n in named]
    # Cells that fold to the same place are one cell.
    sizes = [len(s) for s in shares]
    cell, of = np.unique(np.ravel_multi_index(places, sizes), return_inverse=True) if cells else (np.zeros(0, "i8"),) * 2
    tokens = np.bincount(of, [float(r[words]) for r in cells], len(cell)) if cells else np.zeros(0)
    raked, gap = rake_cells(tokens, list(np.unravel_index(cell, sizes)), shares)
    if gap > REPORTED:
        warnings.warn(f"margins of the mix are up to {gap:.6f} off their shares after {ROUNDS} rounds", stacklevel=3)
    chances = probabilities(tokens, raked, lost)
    weights = np.divide(raked * tokens.sum(), tokens, out=np.zeros_like(raked), where=tokens > 0)
    rows = [(*(r[k] for k in keys), float(weights[i]), float(chances[i])) for r, i in zip(cells, of)]
    columns = ", ".join(f"{f} string" for f in folds)
    known = docs.sparkSession.createDataFrame(rows, f"{columns}, {weight} double, {probability} double")
    same = [F.col(k).eqNullSafe(F.col(f)) for k, f in zip(keys, folds)]
    out = keyed.join(F.broadcast(known) if len(rows) <= DEFAULT_BROADCAST_ROWS else known, same)
    sampled = chance(F.col(id_col), F.col(text_col), seed) < F.col(probability)
    added = [keys[2], words, weight, probability]
    return out.withColumn(f"{own}sampled", sampled).select(*docs.columns, *added, f"{own}sampled"), own
