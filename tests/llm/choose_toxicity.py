"""Choose the machine's costs and ridge by folds. The held-out fifth is never read.

``python tests/llm/choose_toxicity.py FOLDER`` fits on three of the four other fifths and
counts wrong predictions on the fourth, for every combination; the fewest wrong, then the
smallest log loss, then the order below decide. Its result stands in ``toxicity``.
"""

from __future__ import annotations

import math
import sys
import zlib
from concurrent.futures import ProcessPoolExecutor
from itertools import product
from pathlib import Path

import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tesserax.llm import toxicity as tox

GRID = list(product((30.0, 60.0), (10.0, 30.0), (0.3, 1.0)))
FOLDS = (1, 2, 3, 4)


def labelled(folder: str) -> list[tuple[int, str, int]]:
    """(fold, text, label) of the rows outside the held-out fifth, which is filtered in the scan."""
    y = pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist()
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = {r["doc_id"]: r["toxic"] for r in y if r["doc_id"] is not None and r["toxic"] in (0, 1) and fold(r["doc_id"])}
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"], filters=[("doc_id", "in", list(known))])
    return [(fold(r["doc_id"]), r["text"] or "", known[r["doc_id"]]) for r in docs.to_pylist()]


def judged(job) -> tuple[int, float]:
    rows, fold, settings = job
    learnt = [r for r in rows if r[0] != fold]
    model = tox.fit([t for _, t, _ in learnt], [y for _, _, y in learnt], *settings)
    wrong, loss, cache = 0, 0.0, {}
    for f, text, y in rows:
        if f == fold:
            p = min(max(model.probability(tox.document_margin(model, text, cache)), 1e-9), 1 - 1e-9)
            wrong += (p >= 0.5) != bool(y)
            loss -= math.log(p if y else 1 - p)
    return wrong, loss


def main(folder: str) -> None:
    rows = labelled(folder)
    jobs = [(rows, fold, settings) for settings in GRID for fold in FOLDS]
    with ProcessPoolExecutor(4) as pool:
        found = []
        for job, result in zip(jobs, pool.map(judged, jobs), strict=True):
            found.append(result)
            print("fold", job[1], *job[2], *result, flush=True)
    total = []
    for i, settings in enumerate(GRID):
        part = found[i * len(FOLDS) : (i + 1) * len(FOLDS)]
        total.append((sum(w for w, _ in part), round(sum(x for _, x in part), 3), i))
        print(*settings, *total[-1][:2], flush=True)
    print("best: positive cost, negative cost, ridge", GRID[min(total)[2]], "of", len(rows), "rows")


if __name__ == "__main__":
    main(sys.argv[1])
