"""A word n-gram model by deleted interpolation, learned from and applied to whole corpora.

The probability of a token is a mixture of maximum-likelihood estimates: with ``order`` 3, of w after u v,
l3 c(uvw)/c(uv) + l2 c(vw)/c(v) + l1 c(w)/N + l0/(V+1). The weights depend on the bucket of the longest
context that was seen: its length and its count's binary magnitude. They are learned by
expectation-maximisation: the estimates then come from the training documents without those of one fold, and
the weights are fitted to the tokens of that held-out fold. Scores use the counts of all training documents.

Counting and looking up are one exchange for each length. Documents are taken in blocks of some million
tokens. Each block sends its distinct n-grams, as sorted 64-bit hashes with their counts, to the slice of hash
values that they fall in; a slice adds up the counts and answers every block in the order asked. What occurs
once in all documents needs no count in the answer, since the block that asked has it. Longer n-grams are
asked for only where both shorter ones within occur twice or more; elsewhere they occur once, which is known.
No table of the vocabulary is ever broadcast or gathered, and a frequent n-gram is one key per block, so no
slice is hot. Blocks and slices both grow with the square root of the text beyond a GB, up to GROWTH times, so
that messages become larger and their number grows with the text and not with its square.

Defined results: a null or empty text is one token, the end; a null doc_id is in no fold and trains;
repeated rows count each time; other columns are ignored; an empty table gives no rows; without training
documents all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batches, encoded, few, list_array, materialize, mix64, shared_table, train_fold, word_hashes

#: How many times larger than at first blocks and slices become.
GROWTH = 4
END = np.uint64(0x656E64)  # stands for the end of a text, which is also what is before its first word


@dataclass(frozen=True)
class Interpolation:
    parts: int = 7
    test: int = 2  # documents of this fold don't train
    held: int = 3  # of those that train, this fold fits the weights
    order: int = 3
    block_tokens: int = 1_200_000
    slice_bytes: int = 24_000_000  # of text for each slice
    rounds: int = 60
    steps: int = 8  # cells for each factor of two, in the table that the weights are fitted to
    cells: int = 500_000  # that are fitted on the driver (about 80 bytes each); more are fitted in Spark


def _planes(a: np.ndarray) -> bytes:
    """32-bit numbers by bytes of the same rank, which compress well."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


BLOCK = "block string, doc_ids array<long>, folds array<int>, ends array<int>, words binary, tokens binary"


def token_blocks(docs: DataFrame, p: Interpolation) -> DataFrame:
    """Blocks of documents: ids, folds, ends in the token list, distinct words' hashes and tokens as their numbers."""
    tag = F.concat_ws("-", F.spark_partition_id(), F.lit("b"))
    rows = docs.select("doc_id", "text", F.coalesce(train_fold("doc_id", p.parts), F.lit(-1)).cast("int").alias("fold"), tag.alias("part"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, folds, parts, count, made = [], [], [], 0, 0
        part = ""

        def block() -> pa.RecordBatch:
            nonlocal ids, folds, parts, count, made
            words, inv, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            rank = np.argsort(-n, kind="stable")  # frequent words get small numbers
            number = np.empty(len(rank), np.uint32)
            number[rank] = np.arange(len(rank), dtype=np.uint32)
            ends = np.cumsum([len(x) for x in parts]).astype(np.int32)
            cols = [pa.array([f"{part}{made}"]), list_array([np.array(ids, object)], pa.int64()), list_array([np.array(folds, np.int32)], pa.int32())]
            cols += [list_array([ends], pa.int32()), pa.array([words[rank].tobytes()], pa.binary()), pa.array([_planes(number[inv])], pa.binary())]
            ids, folds, parts, count, made = [], [], [], 0, made + 1
            return pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "folds", "ends", "words", "tokens"])

        for batch in it:
            every, upto = word_hashes(encoded(batch.column("text"), LOWER))
            own = np.split(every, upto[:-1]) if len(upto) else []
            for doc, fold, at, h in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "fold", "part")), own, strict=True):
                part, h = at, np.append(h, END)
                ids.append(doc), folds.append(fold), parts.append(h)
                count += len(h)
                if count >= p.block_tokens:
                    yield block()
        if ids:
            yield block()

    return batches(rows, run, BLOCK)


class _Block:
    """A block's tokens as distinct n-grams (of n - 1 = kind words before the token), each kind sorted by hash."""

    def __init__(self, row: dict, p: Interpolation):
        words = np.frombuffer(row["words"], np.uint64)
        self.h = words[_numbers(row["tokens"])]
        self.ids, self.ends = row["doc_ids"], np.array(row["ends"], np.int64)
        self.folds = np.array(row["folds"], np.int64)
        size = np.diff(self.ends, prepend=0)
        fold = np.repeat(self.folds, size)
        #: 1 for tokens that are in all estimates, 2 for those held out from the weights' ones, 3 for those of the test
        self.use = np.where(fold == p.test, 3, np.where(fold == p.held, 2, 1)).astype(np.uint8)
        self.offset = np.arange(len(self.h)) - np.repeat(self.ends - size, size)

    def keys(self, kind: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, and the place among them of each token, or of those at the places ``at``."""
        at = np.arange(len(self.h)) if at is None else at
        found = None
        with np.errstate(over="ignore"):
            for back in range(kind, -1, -1):
                # before a text's first word there are only ends
                word = np.where(self.offset[at] >= back, self.h[np.maximum(at - back, 0)], END) if back else self.h[at]
                found = mix64(word if found is None else found + word)
        return np.unique(found, return_inverse=True)


def _packed(codes: np.ndarray) -> bytes:
    """Numbers from 0 to 3, four to a byte."""
    c = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).astype(np.uint8).tobytes()


def _codes(raw: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(raw, np.uint8)
    return ((c[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()[:n]


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, by bytes of the same rank; the upper ones are mostly 0."""
    d = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(d.T).tobytes()


def _keys(raw: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


REQUEST = "kind int, slice int, block string, n int, keys binary, once binary, counts binary"


def _asked(b: _Block, block: str, kind: int, at: np.ndarray | None, edges: np.ndarray) -> pa.RecordBatch:
    """REQUEST rows of a block's n-grams, one for each slice: keys; of what comes once the token's use, else 0; counts of each use of the rest."""
    keys, inv = b.keys(kind, at)
    use = b.use if at is None else b.use[at]
    n = np.stack([np.bincount(inv[use == u], minlength=len(keys)) for u in (1, 2, 3)])
    once = np.where(n.sum(axis=0) == 1, n.argmax(axis=0) + 1, 0).astype(np.uint8)
    cut = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    rows = [(k, slice(cut[k], cut[k + 1])) for k in range(len(cut) - 1) if cut[k] < cut[k + 1]]
    cols = [pa.array([kind] * len(rows), pa.int32()), pa.array([k for k, _ in rows], pa.int32()), pa.array([block] * len(rows)), pa.array([s.stop - s.start for _, s in rows], pa.int32())]
    cols.append(pa.array([_steps(keys[s]) for _, s in rows], pa.binary()))
    cols.append(pa.array([_packed(once[s]) for _, s in rows], pa.binary()))
    cols.append(pa.array([_planes(n[:, s][:, once[s] == 0].ravel()) for _, s in rows], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, ["kind", "slice", "block", "n", "keys", "once", "counts"])


ANSWER = "kind int, slice int, block string, n int, more binary, kept binary, every binary, stats array<double>"


def _answers(requests: DataFrame) -> DataFrame:
    """ANSWER rows: for every request, in its order, which n-grams come twice or more in all documents, and those ones'
    totals; and, with a null block, each slice's tokens and distinct tokens in both sets of estimates."""

    def run(t: pa.Table) -> pa.Table:
        kind, at = t.column("kind")[0].as_py(), t.column("slice")[0].as_py()
        parts = [_keys(x.as_buffer()) for x in t.column("keys")]
        ends = np.cumsum([len(x) for x in parts])
        distinct, inv = np.unique(np.concatenate(parts), return_inverse=True)
        del parts
        sums = np.zeros((3, len(distinct)), np.int64)
        for upto, n, once, counts in zip(ends.tolist(), *(t.column(c) for c in ("n", "once", "counts")), strict=True):
            n = n.as_py()
            own, codes = inv[upto - n : upto], _codes(once.as_buffer(), n)
            several = _numbers(counts.as_buffer()).reshape(3, -1)
            for u in range(3):
                sums[u, own[codes == u + 1]] += 1
                sums[u, own[codes == 0]] += several[u]
        more, every = sums.sum(axis=0) > 1, sums[0] + sums[1]
        stats = [float(sums[0].sum()), float((sums[0] > 0).sum()), float(every.sum()), float((every > 0).sum())]
        out: list[list[bytes]] = [[], [], []]
        for a, b in zip([0, *ends.tolist()], ends.tolist()):
            own = inv[a:b]
            many = own[more[own]]
            for x, raw in zip(out, (np.packbits(more[own]).tobytes(), _planes(sums[0][many]), _planes(every[many])), strict=True):
                x.append(raw)
        n = t.num_rows + 1
        cols = [pa.array([kind] * n, pa.int32()), pa.array([at] * n, pa.int32()), pa.array([*t.column("block").to_pylist(), None], pa.string())]
        cols += [pa.array([*t.column("n").to_pylist(), None], pa.int32()), *(pa.array([*x, None], pa.binary()) for x in out)]
        cols.append(pa.array([None] * (n - 1) + [stats], pa.list_(pa.float64())))
        return pa.Table.from_arrays(cols, [c.split()[0] for c in ANSWER.split(", ")])

    return requests.groupBy("kind", "slice").applyInArrow(run, ANSWER)


def _totals(b: _Block, answers: pa.Table, kind: int, column: str, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each token's n-gram, or of those at the places ``at``: whether it comes twice or more, and its count in the estimates."""
    rows = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("slice")
    keys, inv = b.keys(kind, at)
    several = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n.as_py()).astype(bool) for x, n in zip(rows.column("more"), rows.column("n"), strict=True)]
    more = np.concatenate([np.empty(0, bool), *several])
    counts = np.zeros(len(keys), np.float64)
    counts[more] = np.concatenate([np.empty(0, np.uint32), *(_numbers(x.as_buffer()) for x in rows.column(column))])
    use = b.use if at is None else b.use[at]
    alone = use == 1 if column == "kept" else use <= 2
    return more[inv], np.where(more[inv], counts[inv], alone)


def _open(b: _Block, more: np.ndarray) -> np.ndarray:
    """Places of the tokens whose n-gram, and the one before it in the text, come twice or more: only there a longer one can."""
    before = np.concatenate([[True], more[:-1]]) | (b.offset == 0)
    return np.flatnonzero(more & before)


def _counts(b: _Block, answers: pa.Table, column: str, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of every token, the counts of its n-grams of each length from 1 on, and of the contexts of those from 2 on."""
    grams, contexts, at = [], [], None
    start = b.offset == 0
    for kind in range(order):
        found, n = _totals(b, answers, kind, column, at)
        if at is None:
            more, count = found, n
        else:
            more, count = np.zeros(len(b.h), bool), (b.use == 1 if column == "kept" else b.use <= 2).astype(np.float64)
            more[at], count[at] = found, n
        if kind == 0:  # texts begin after as many ends as there are texts
            end = count[np.flatnonzero(b.h == END)[0]]
        grams.append(count)
        contexts.append(np.where(start, end, np.concatenate([[end], count[:-1]])))
        if kind:
            at = _open(b, more)
    return grams, contexts[:-1]


def bucket(contexts: list[np.ndarray]) -> np.ndarray:
    """Of the longest context with a count, 32 times its length and the count's binary magnitude: 1, 2-3, 4-7 and so on; 0 if there is none."""
    out = np.zeros(len(contexts[0]), np.int64) if contexts else 0
    for k, n in enumerate(contexts):
        out = np.where(n > 0, 32 * (k + 1) + np.minimum(np.ceil(np.log2(n + 1)), 31).astype(np.int64), out)
    return out


def _first_weights(p: Interpolation) -> tuple[np.ndarray, np.ndarray]:
    """The estimates whose context was seen, by bucket, and equal weights of these."""
    known = np.maximum(np.arange(32 * p.order) // 32, 0)[:, None] + 1 >= np.arange(p.order + 1)
    return known, known / known.sum(axis=1, keepdims=True)


def fit_weights(cells: pd.DataFrame, p: Interpolation, floor: float) -> np.ndarray:
    """Weights (bucket, order from 0 on) by expectation-maximisation on held-out tokens.

    cells: bucket, n tokens, and f1, f2 and so on, the sums of their estimates; or q1, q2 and so on, the
    logarithms of one token's estimates in steps.
    """
    known, out = _first_weights(p)
    of_one = lambda own, j: own[f"f{j}"].to_numpy(float) / own.n.to_numpy(float) if f"f{j}" in own else 2.0 ** (own[f"q{j}"].to_numpy(float) / p.steps)
    for k, of in cells.groupby("bucket"):
        f = np.stack([np.full(len(of), floor), *(of_one(of, j) for j in range(1, p.order + 1))], 1)
        n = of.n.to_numpy(float)[:, None]
        for _ in range(p.rounds):
            share = f * out[k]
            share /= share.sum(axis=1, keepdims=True)
            got = (share * n).sum(axis=0) + 0.5 * known[k]  # every order keeps some weight
            out[k] = got / got.sum()
    return out


def fit_weights_by_rounds(cells: DataFrame, p: Interpolation, floor: float) -> np.ndarray:
    """fit_weights() on a table of any size: a round is one aggregate over all cells, of which a row for each bucket comes back."""
    known, out = _first_weights(p)
    for _ in range(p.rounds):
        flat = F.array(*map(F.lit, out.ravel().tolist()))
        parts = [F.get(flat, F.col("bucket") * (p.order + 1) + j) * (F.col(f"f{j}") / F.col("n") if j else F.lit(floor)) for j in range(p.order + 1)]
        share = [F.sum(F.col("n") * x / sum(parts[1:], parts[0])).alias(f"s{j}") for j, x in enumerate(parts)]
        for r in cells.groupBy("bucket").agg(*share).collect():
            got = np.array(r[1:], float) + 0.5 * known[r["bucket"]]
            out[r["bucket"]] = got / got.sum()
    return out


def estimates(grams: list[np.ndarray], contexts: list[np.ndarray], total: float) -> list[np.ndarray]:
    """Maximum-likelihood estimates of each order from 1 on; 0 without the context."""
    return [g / np.maximum(c, 1) for g, c in zip(grams, [np.full(len(grams[0]), max(total, 1.0)), *contexts], strict=True)]


def interpolated_scores(docs: DataFrame, p: Interpolation = Interpolation()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grown = min(max(1.0, (size / 1e9) ** 0.5), GROWTH)
    slices = max(8, -(-size // int(p.slice_bytes * grown)))
    edges = np.array([(k << 64) // slices for k in range(1, slices)], np.uint64)
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = token_blocks(docs, replace(p, block_tokens=int(p.block_tokens * grown)))
    blocks = shared_table(made, "lm-blocks", "block", max(shuffles, slices))

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                b = _Block(row, p)
                for kind in range(min(2, p.order)):
                    yield _asked(b, row["block"], kind, None, edges)

    answers = materialize(_answers(batches(blocks, first, REQUEST)), "lm-answers")
    total = answers.filter("kind = 0 AND stats IS NOT NULL").select(*(F.sum(F.get("stats", k)) for k in range(4))).first()
    kept_n, kept_v, all_n, all_v = (x or 0.0 for x in total)
    answers = answers.filter("block IS NOT NULL").drop("stats")

    def joined(f, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(f, schema)

    def longer(kind: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            for row in left.to_pylist():
                b, at = _Block(row, p), None
                for k in range(1, kind):
                    more = np.zeros(len(b.h), bool)
                    more[slice(None) if at is None else at] = _totals(b, right, k, "kept", at)[0]
                    at = _open(b, more)
                out.append(_asked(b, row["block"], kind, at, edges))
            return pa.Table.from_batches(out)

        return run

    for kind in range(2, p.order):
        more = materialize(_answers(joined(longer(kind), REQUEST)), "lm-answers")
        answers = answers.unionByName(more.filter("block IS NOT NULL").drop("stats"))

    names, sums = ["bucket", *(f"q{j}" for j in range(1, p.order + 1))], [*(f"f{j}" for j in range(1, p.order + 1)), "n"]

    def held_out(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            b = _Block(row, p)
            grams, contexts = _counts(b, right, "kept", p.order)
            on = b.use == 2
            grams, contexts = [x[on] for x in grams], [x[on] for x in contexts]
            with np.errstate(divide="ignore"):
                every = estimates(grams, contexts, kept_n)
                q = [np.round(np.log2(f) * p.steps) for f in every]
            at = bucket(contexts) if contexts else np.zeros(on.sum(), np.int64)
            rows.append(pd.DataFrame(dict(zip([*names, *sums], [at, *q, *every, np.ones(len(at), np.int64)], strict=True))))
        cells = pd.concat(rows).replace(-np.inf, -1e9).groupby(names)[sums].sum().reset_index()
        return pa.Table.from_pandas(cells.astype({c: "int32" for c in names} | {"n": "int64"}), preserve_index=False)

    # tokens with about equal estimates are one cell, which stands for their means
    schema = ", ".join([*(f"{c} int" for c in names), *(f"{c} {'long' if c == 'n' else 'double'}" for c in sums)])
    cells = materialize(joined(held_out, schema).groupBy(*names).agg(*(F.sum(c).alias(c) for c in sums)).select("bucket", *sums), "lm-cells")
    here = few(cells, p.cells)
    # as columns: Python's rows would take several hundred bytes a cell
    weights = fit_weights(cells.toArrow().to_pandas(), p, 1 / (kept_v + 1)) if here else fit_weights_by_rounds(cells, p, 1 / (kept_v + 1))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = _Block(row, p)
            grams, contexts = _counts(b, right, "every", p.order)
            l = weights[bucket(contexts) if contexts else np.zeros(len(b.h), np.int64)]  # noqa: E741
            token = l[:, 0] / (all_v + 1)
            for k, f in enumerate(estimates(grams, contexts, all_n)):
                token += l[:, k + 1] * f
            base = np.log10((grams[0] + 1) / (all_n + all_v + 1))
            start = np.concatenate([[0], b.ends[:-1]])
            add = lambda x: np.add.reduceat(x, start)  # noqa: B023, E731
            cols = {"doc_id": pa.array(b.ids, pa.int64()), "held_out": pa.array(b.folds == p.test), "n_tokens": pa.array(np.diff(b.ends, prepend=0))}
            cols |= {"n_known": pa.array(add((grams[0] > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(b.ids), int(all_n)))}
            out.append(pa.table(cols | {"base_score": pa.array(add(base)), "score": pa.array(add(np.log10(token)))}))
        return pa.concat_tables(out)

    return joined(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
