"""The first k of many hashed draws a case, without a row for each draw outside the tasks.

A draw is ``vectors.hashed_unit`` of the seed, the case and the paper. Cases and candidates of one group meet
in the cells of a grid; a cell computes the first 32 bits of all its draws as arrays and lets go only those
that can still be among the first k when draws are rounded. Those are drawn and ranked again as columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.functions import metrics as M
from facetlake.functions import vectors as V
from facetlake.functions.digests import first_words

#: Candidates and cases for which a side of the grid gets one more row of cells; draws and candidates that are computed at once.
CANDIDATES, CASES, AT_ONCE, WIDE = 75_000, 6_000, 25_000, 12_500


def hashed_top(cases: DataFrame, candidates: DataFrame, group: str, k: int, seed: str = "42", digits: int = 6) -> DataFrame:
    """(case_id, paper_id, score, rank): the first k other papers of each case's group by rounded draw, then by paper.

    cases: group, case_id, query_paper_id; candidates: group, paper_id.
    """
    down, across = max(1, cases.count() // CASES), max(8, candidates.count() // CANDIDATES)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = [group, "_down", "_across"]
    at = lambda rows: rows.filter(F.col(group).isNotNull()).repartition(2 * down * across, *cell).groupBy(*cell)
    left = at(cases.select(group, "case_id", "query_paper_id", deal("case_id", down).alias("_down"), every(across).alias("_across")))
    right = at(candidates.select(group, "paper_id", every(down).alias("_down"), deal("paper_id", across).alias("_across")))
    kinds = dict(cases.dtypes) | dict(candidates.dtypes)
    found = left.cogroup(right).applyInArrow(_first(k + 1, seed, digits), f"case_id string, query_paper_id {kinds['query_paper_id']}, paper_id {kinds['paper_id']}")
    drawn = found.filter("paper_id <> query_paper_id").select("case_id", "paper_id", F.round(V.hashed_unit(seed, F.col("case_id"), F.col("paper_id")), digits).alias("score"))
    return M.top(drawn, k, ["case_id"])


def by_size(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes as rows) of the texts of each size."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return [(at := np.flatnonzero(sizes == n), np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(len(at), n)) for n in np.unique(sizes)]


def _largest(words: np.ndarray, k: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the words that are below their row's k-th largest one by ``near`` at most."""
    rows, n = words.shape
    if n <= k:
        return np.nonzero(np.ones(words.shape, bool))
    if 4 * k < n:  # draws are even, so few are sorted: those above a bound that leaves some 4 * k
        bound = int(2**32 * (1 - 4 * k / n))
        r, c = np.nonzero(words >= np.uint32(bound))
        if (np.bincount(r, minlength=rows) >= k).all():
            found = words[r, c].astype(np.int64)
            order = np.lexsort((-found, r))
            least = found[order[np.searchsorted(r, np.arange(rows)) + k - 1]] - near
            if (least >= bound).all():
                keep = found >= least[r]
                return r[keep], c[keep]
    least = np.partition(words, n - k, axis=1)[:, n - k].astype(np.int64) - near
    return np.nonzero(words >= np.maximum(least, 0).astype(np.uint32)[:, None])


def _first(k: int, seed: str, digits: int):
    near = 2**32 // 10**digits + 2  # draws that round alike differ by less

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        heads = by_size([f"{seed}:{x}:".encode() for x in left["case_id"].to_pylist()])
        tails = by_size([str(x).encode() for x in right["paper_id"].to_pylist()])
        rows, columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for there, tail in tails:
            for j in range(0, len(there), WIDE):
                some, n = tail[j : j + WIDE], len(there[j : j + WIDE])
                step = max(2, AT_ONCE // n)
                for here, head in heads:
                    for i in range(0, len(here), step):
                        words = first_words(head[i : i + step], some)
                        r, c = _largest(words, k, near)
                        rows.append(here[i + r])
                        columns.append(there[j + c])
        met = left.take(pa.array(np.concatenate(rows))).select(["case_id", "query_paper_id"])
        return met.append_column("paper_id", right["paper_id"].take(pa.array(np.concatenate(columns))))

    return run
