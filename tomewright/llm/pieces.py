"""SentencePiece BPE encoding by backtracking over longest matches, and decoding, on whole texts."""

from __future__ import annotations

import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, slices, text_lengths, texts_of

SPACE = "▁"
#: Letters and digits that marks are told from, as a class of a pattern.
LETTERS = r"a-zA-Z0-9\u00c0-\u024f"
#: Characters of encoded stretches, and of token pairs, that each worker remembers, each entry counted as so many more;
#: beyond it the older half is forgotten. A stretch of over ``KEPT`` characters is not remembered.
CACHES, ENTRY, KEPT = (12_000_000, 5_000_000), 24, 200
#: The same for a worker that has little memory: some 50 MB less, for half as much time again.
LEAN = (4_000_000, 3_000_000)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Memo(dict):
    """A bounded cache: what is missing is computed, and past ``most`` characters of keys the older half goes."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        value, size = self.make(key), ENTRY + (len(key) if isinstance(key, str) else sum(map(len, key)))
        if size > ENTRY + KEPT:
            return value
        if self.held + size > self.most:
            for old in list(self)[: len(self) // 2 + 1]:
                del self[old]
            self.held = sum(ENTRY + (len(k) if isinstance(k, str) else sum(map(len, k))) for k in self)
        self.held += size
        self[key] = value
        return value


class PieceModel:
    """A BPE piece model with byte fallback and identity normalization.

    A stretch of text has exactly one segmentation in which every two neighbouring tokens stay apart when their joined
    text is merged on its own; that one is what merging the whole stretch gives. So encoding is a search: take the
    longest piece that matches, keep it if it is compatible with the token before, else try its next shorter prefix,
    and step back when none is left. A position from which no way led to the end is marked in a bit field and not
    entered again, since the tokens that lead to a position are unique.
    """

    def __init__(self, path: str, caches: tuple[int, int] = CACHES):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("a BPE model with identity normalization, kept white space and a leading space is needed")
        kinds = pb.ModelProto.SentencePiece
        self.eos = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>" and p.type == kinds.CONTROL)
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.is_byte = [p.type == kinds.BYTE for p in model.pieces]
        self.raw = [b"" if p.type == kinds.CONTROL else b" \xe2\x81\x87 " if p.type == kinds.UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.cut = re.compile(self._borders()).findall
        self.joins = _Memo(lambda pair: self.merge(pair[0] + pair[1]) == [*pair], caches[1])
        self.find = ahocorasick.Automaton()
        for piece in self.id:
            if len(piece) == 1 or self.merge(piece) == [piece]:
                self.find.add_word(piece, piece)
        self.find.make_automaton()
        self.shorter = {x: next((x[:n] for n in range(len(x) - 1, 0, -1) if x[:n] in self.find), None) for x in self.find}
        self.memo = _Memo(self._stretch, caches[0])

    def _borders(self) -> str:
        """A pattern that finds the stretches of a text between places that no piece spans, so that no merge crosses them.

        Such places are: before a space sign that follows another character, around a newline, and between a letter or digit
        and a mark that no piece has after one.
        """
        before: dict[str, set[str]] = {}
        for piece in self.id:
            for a, b in zip(piece, piece[1:]):
                before.setdefault(b, set()).add(a)
        if before.get(SPACE, set()) - {SPACE} or "\n" in before or any("\n" in v for v in before.values()):
            return r"(?s).+"
        letter = re.compile(f"[{LETTERS}]").match
        marks = {c for piece in self.id for c in piece if not letter(c) and c not in (SPACE, "\n") and not any(map(letter, before.get(c, ())))}
        rest = f"[^{SPACE}\\n{LETTERS}]*"
        # after letters a stretch goes on over a mark that may follow one, and then over all marks up to the next letters
        more = f"(?:[^{SPACE}\\n{LETTERS}{''.join(map(re.escape, sorted(marks)))}]{rest})?"
        return f"(?=[^\\n]){SPACE}*{rest}(?:[{LETTERS}]+{more})*|\\n"

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short text: the best-scored neighbouring pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stretch(self, text: str) -> tuple[int, ...]:
        end = len(text)
        longest: list[str | None] = [None] * end
        for last, piece in self.find.iter(text):
            longest[last - len(piece) + 1] = piece
        tokens: list[str] = []
        joins, shorter = self.joins, self.shorter
        failed = at = 0
        piece, fresh = longest[0], True  # fresh: whether ``piece`` is the longest at its position
        before: str | None = None  # the last token, unless nothing merges with it
        while True:
            while piece is not None:
                after = at + len(piece)
                if not failed >> after & 1 and (before is None or joins[before, piece]):
                    tokens.append(piece)
                    before = piece
                    break
                piece = shorter[piece]
            else:
                if fresh and longest[at] is None:  # a character outside the vocabulary
                    tokens.append(text[at])
                    before, after = None, at + 1
                else:
                    failed |= 1 << at
                    last = tokens.pop()
                    at -= len(last)
                    before = tokens[-1] if tokens and tokens[-1] in shorter else None
                    piece, fresh = shorter.get(last), False
                    continue
            if after == end:
                break
            at, piece, fresh = after, longest[after], True
        ids, byte = self.id, self.byte
        try:
            return tuple([ids[t] for t in tokens])
        except KeyError:
            return tuple(chain.from_iterable([ids[t]] if t in ids else [byte[b] for b in t.encode("utf-8", "surrogatepass")] for t in tokens))

    def encode(self, text: str, eos: bool = True) -> list[int]:
        ids = list(chain.from_iterable(map(self.memo.__getitem__, self.cut(SPACE + text.replace(" ", SPACE))))) if text else []
        return [*ids, self.eos] if eos else ids

    def decode(self, ids) -> str:
        raw = list(map(self.raw.__getitem__, ids))
        try:
            text = b"".join(raw).decode() if b"" not in raw[:-1] else self._repair(ids)  # bytes don't join across a control id
        except UnicodeDecodeError:
            text = self._repair(ids)
        return text[1:] if text.startswith(" ") and self._leads(ids) else text

    def _leads(self, ids) -> bool:
        """Whether the text's first space is the one that encoding put there."""
        first = next((i for i in ids if self.raw[i]), None)
        return first is not None and not self.is_byte[first] and self.raw[first] != b" \xe2\x81\x87 "

    def _repair(self, ids) -> str:
        """Bytes that are no character become U+FFFD one by one."""
        out, run = [], bytearray()

        def flush():
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.is_byte[i]:
                run += self.raw[i]
            else:
                flush()
                out.append(self.raw[i].decode())
        flush()
        return "".join(out)


_LOADED: dict[tuple, PieceModel] = {}


def load(path: str, caches: tuple[int, int] = CACHES) -> PieceModel:
    if (path, caches) not in _LOADED:
        _LOADED[path, caches] = PieceModel(path, caches)
    return _LOADED[path, caches]


def encode_pieces(docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", model: str | None = None, eos: bool = True, caches: tuple[int, int] = CACHES) -> DataFrame:
    """``docs`` without ``text`` and with ``ids`` (array of int) and, if named, ``decoded``: the text decoded from ids.

    Encoding is exact for the whole text, however long; null and empty texts have only the end id and decode to the
    empty text. Rows are independent: no shuffle, repeated rows stay, all other columns pass through unchanged. Columns
    of ``docs`` named like the results are replaced. An empty table gives an empty result. ``caches`` bounds what each worker
    remembers; it changes time and memory only.
    """
    path = model or default_model()
    kept = [f for f in docs.schema.fields if f.name not in (text, ids, decoded)]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.StringType())] if decoded else [])])

    def run(batches):
        pieces = load(path, caches)
        for batch in batches:
            for lo, hi in slices(text_lengths(batch.column(len(names)))):
                part = batch.slice(lo, hi - lo)
                lists = [pieces.encode(t, eos) for t in texts_of(part.column(len(names)))]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                values = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(ends[-1]))
                columns = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
                if decoded:
                    columns.append(pa.array(map(pieces.decode, lists), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow_map(docs.select(*names, text), run, schema)


def decode_pieces(rows: DataFrame, ids: str = "ids", decoded: str = "decoded", model: str | None = None) -> DataFrame:
    """``rows`` with the text of ``ids`` as ``decoded``; null ids decode to null, control ids to nothing."""
    path = model or default_model()
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != decoded], T.StructField(decoded, T.StringType())])

    def run(batches):
        pieces = load(path)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in schema.names[:-1]], pa.array(texts, pa.string())], names=schema.names)

    return arrow_map(rows.drop(decoded), run, schema)
