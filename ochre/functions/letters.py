"""The two loops over single letters, which run in Python on Arrow batches: what of a text is sequence, and where codons stand.

Spark deals rows out and takes them on; a batch knows nothing of others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Stops handed on at once.
FLUSH = 1 << 16
_LETTERS = bytes(range(65, 91))
_OTHERS = bytes(sorted(set(range(256)) - set(_LETTERS)))


def letters_of(raw: bytes | None, table: bytes) -> bytes:
    """``sequence.normalized`` of a text in UTF-8; ``table`` says as what each letter is read."""
    if raw is None:
        return b""
    upper = raw.upper() if raw.isascii() else raw.decode("utf-8", "replace").upper().encode("ascii", "ignore")
    return upper.translate(table, _OTHERS)


def reading(letters: str = "", instead: str = "") -> bytes:
    return bytes.maketrans(("U" + letters).encode(), ("T" + instead).encode())


def sequences(table: bytes, schema: pa.Schema):
    """For ``mapInArrow``: a key and a text become the key and the text's letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [letters_of(raw, table) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], schema=schema)

    return run


def codon_places(plus: list[str], minus: list[str], named: list[str], chunk: int, origin: bool, schema: pa.Schema):
    """For ``mapInArrow`` on ``seq_idx, seq_id, length, circular, seq``: the rows of ``scan.codon_windows``.

    ``named`` codons are found on the forward strand where ``plus`` (as they are) or
    ``minus`` (their reverse complements) has something at their place, else "".
    """
    used = sorted({c for codon in (*plus, *minus) for c in codon.encode()})
    k = len(used) + 1
    number = np.zeros(256, np.int32)
    number[used] = np.arange(1, k)
    at = lambda codon: int((number[codon.encode()[0]] * k + number[codon.encode()[1]]) * k + number[codon.encode()[2]])
    # by strand, for each three letters, one more than the codon's place in ``named``
    tables = [np.zeros(k**3, np.int32) for _ in range(2)]
    for table, own in zip(tables, (plus, minus)):
        for place, codon in enumerate(own):
            if codon:
                table[at(codon)] = place + 1
    either = (tables[0] > 0) | (tables[1] > 0)
    names, sides = pa.array(named, pa.string()), pa.array(["+", "-"])

    def in_piece(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = number[piece]
        code = (c[:-2] * k + c[1:-1]) * k + c[2:]
        where = np.flatnonzero(either[code])
        return where, code[where]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([-1 if n is None else n for n in batch.column(2).to_pylist()], np.int64)
            rounds, seqs = batch.column(3).to_pylist(), batch.column(4)
            held: list[tuple[int, bool, np.ndarray, np.ndarray]] = []
            count = 0

            def rows() -> pa.RecordBatch:
                row = np.concatenate([np.full(len(w), r) for r, _, w, _ in held])
                wraps = np.concatenate([np.full(len(w), x) for _, x, w, _ in held])
                start, code = np.concatenate([w for _, _, w, _ in held]), np.concatenate([c for *_, c in held])
                side = np.concatenate([np.full(int((t[code] > 0).sum()), s) for s, t in enumerate(tables)])
                pick = np.concatenate([np.flatnonzero(t[code] > 0) for t in tables])
                codon = np.concatenate([t[code][t[code] > 0] for t in tables]) - 1
                row, wraps, start = row[pick], wraps[pick], start[pick]
                length = lengths[row]
                rpos = np.where(side == 1, (length - 3 - start) % length, start)
                take = pa.array(row)
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(length.astype(np.int32)), sides.take(pa.array(side)), pa.array(rpos.astype(np.int32)), names.take(pa.array(codon)), pa.array(wraps)]
                return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

            for r in range(batch.num_rows):
                n, data = lengths[r], seqs[r].as_buffer()
                if n < 3 or data is None:
                    continue
                seq = np.frombuffer(data, np.uint8)
                for base in range(0, n - 2, chunk):
                    where, code = in_piece(seq[base : base + chunk + 2])
                    if len(where):
                        held.append((r, False, where + base, code))
                        count += len(where)
                    if count >= FLUSH:
                        yield rows()
                        held, count = [], 0
                if origin and rounds[r]:
                    where, code = in_piece(np.concatenate([seq[n - 2 :], seq[:2]]))
                    if len(where):
                        held.append((r, True, where + (n - 2), code))
                        count += len(where)
            if held:
                yield rows()

    return run
