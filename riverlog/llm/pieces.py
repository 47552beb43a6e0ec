"""SentencePiece encoding and decoding with a table of prefixes.

The library encodes by merging: again and again the best-scored pair of
neighbours that makes a piece, the leftmost of equals.  The result for a text
has a plain structure: every prefix of the text has one last token, and a token
sequence is the result exactly if each two neighbours are, alone, the result
for their concatenation.  So an automaton reports all pieces that end at a
place, and that piece is stored whose predecessor - the stored token of the
prefix before it - is compatible with it.  Ids are read backwards from the
table.  Compatibility of a pair is decided by merging the two, once per pair.

No piece of the vocabulary has the space mark behind another character, so no
token spans two units "marks, then other characters"; units are encoded each by
itself, and those seen lately are kept.  Characters that are no piece become
their bytes.

Results for odd input: a null text is encoded as an empty one, which has no
tokens; equal texts have equal tokens; whole texts are encoded whatever their
length, with memory in proportion to the text; an empty table stays empty; extra
columns stay in ``encode_column`` and ``decode_column``, which replace a column
named like their result, and are not read by ``digests``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# Units remembered per Python worker, in two generations: when the young one is
# full it becomes the old one, and what is met again moves back.  Pairs likewise
# are forgotten when full.
UNITS = 200_000
PAIRS = 1_000_000
UNIT_CHARS = 48


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """Plain merging of a short text, the definition that the table must equal."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class PieceCoder:
    """One model's pieces; made once per worker and path."""

    _made: dict[str, PieceCoder] = {}

    @classmethod
    def of(cls, path: str) -> PieceCoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: list[int] = [0] * 256
        self.output: list[bytes | int | None] = []  # per id: its characters, a single byte, or nothing
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.output.append(value)
            elif model.is_control(i):
                self.output.append(None)
            elif model.is_unknown(i):
                self.output.append(" ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
                self.output.append(piece.replace(MARK, " ").encode())
        self._marked = {i for piece, i in self.ids.items() if piece.startswith(MARK)}
        across = any(MARK in piece.lstrip(MARK) for piece in self.ids)
        self._unit = re.compile("(?s).+") if across else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self._by_space = not across
        self._automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if merged(piece, self.scores) == [piece]:
                self._automaton.add_word(piece, piece)
        self._automaton.make_automaton()
        self._pairs: dict[tuple[str, str], bool] = {}
        # by unit without its first mark: ids in decimal, and decoded text
        self._ids: dict[str, str] = {}
        self._texts: dict[str, str] = {}
        self._old: tuple[dict[str, str], dict[str, str]] = {}, {}

    def _compatible(self, left: str, right: str) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[left, right] = merged(left + right, self.scores) == [left, right]
        return known

    def tokens(self, unit: str) -> list[str]:
        """The pieces of a unit, or its characters where they are no piece."""
        last: list[str | None] = [None] * (len(unit) + 1)
        last[0] = ""
        pairs, compatible = self._pairs, self._compatible
        done = 0  # prefixes up to here have their token
        for at, piece in self._automaton.iter(unit):
            if done > at:
                continue  # this prefix has its token already
            while done < at:
                done += 1
                last[done] = unit[done - 1]
            before = last[at + 1 - len(piece)]
            if not before or pairs.get((before, piece)) or ((before, piece) not in pairs and compatible(before, piece)):
                done = at + 1
                last[done] = piece
        while done < len(unit):
            done += 1
            last[done] = unit[done - 1]
        parts, at = [], len(unit)
        while at:
            parts.append(last[at])
            at -= len(last[at])
        return parts[::-1]

    def unit_ids(self, unit: str) -> list[int]:
        ids: list[int] = []
        for part in self.tokens(unit):
            known = self.ids.get(part)
            if known is not None:
                ids.append(known)
            else:
                ids.extend(self.bytes[value] for value in part.encode())
        return ids

    def _units_of(self, text: str) -> list[str]:
        return self._unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for unit in self._units_of(text) for i in self.unit_ids(unit)]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; bytes that are no character become U+FFFD, one each.
        ``first``: the space before the first piece is the one encoding put there."""
        out: list[bytes] = []
        pending = bytearray()
        for i in ids:
            value = self.output[i]
            if isinstance(value, int):
                pending.append(value)
                continue
            if pending:
                out.append(_characters(bytes(pending)))
                pending.clear()
            if value is not None:
                out.append(value)
        if pending:
            out.append(_characters(bytes(pending)))
        text = b"".join(out).decode()
        lead = next((i for i in ids if self.output[i] is not None), None) if first else None
        # only a piece brings the space that encoding put in front; a byte or the unknown does not
        return text[1:] if lead in self._marked else text

    def _keys(self, text: str) -> list[str]:
        """The units of a text, each without its first mark; every unit has one."""
        if self._by_space and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [unit[1:] for unit in self._units_of(text)]

    def _learn(self, key: str) -> None:
        ids = self._old[0].get(key)
        if ids is not None:
            self._ids[key], self._texts[key] = ids, self._old[1][key]
            return
        numbers = self.unit_ids(MARK + key)
        self._ids[key] = ",".join(map(str, numbers))
        self._texts[key] = self.decode(numbers, first=False)

    def both(self, text: str) -> tuple[str, str]:
        """Ids in decimal, joined by commas, and the text decoded from them."""
        if not text:
            return "", ""
        keys = self._keys(text)
        fresh = set(keys).difference(self._ids)
        for key in fresh:
            self._learn(key)
        ids = ",".join(map(self._ids.__getitem__, keys))
        decoded = "".join(map(self._texts.__getitem__, keys))[1:]
        for key in fresh:
            if len(key) >= UNIT_CHARS:
                del self._ids[key], self._texts[key]
        if len(self._ids) >= UNITS:
            self._old, self._ids, self._texts = (self._ids, self._texts), {}, {}
        return ids, decoded


def _characters(data: bytes) -> bytes:
    out = []
    while data:
        try:
            out.append(data.decode().encode())
            break
        except UnicodeDecodeError as error:
            out.append(data[: error.start])
            out.append("�".encode())
            data = data[error.start + 1 :]
    return b"".join(out)


def encode_column(docs: DataFrame, path: str, column: str = "text", to: str = "ids") -> DataFrame:
    """All rows and columns with the ids of a text column."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        coder = PieceCoder.of(path)
        return texts.map(lambda text: coder.encode(text or ""))

    return docs.withColumn(to, ids(F.coalesce(F.col(column), F.lit(""))))


def decode_column(docs: DataFrame, path: str, column: str = "ids", to: str = "decoded") -> DataFrame:
    """All rows and columns with the text of an array of ids; null stays null."""

    @F.pandas_udf("string")
    def text(ids):
        coder = PieceCoder.of(path)
        return ids.map(lambda one: None if one is None else coder.decode([int(i) for i in one]))

    return docs.withColumn(to, text(column))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of its ids and of what they decode to."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder.of(path)
        for batch in batches:
            texts = batch.column("text")
            sizes, of_ids, of_texts = [], [], []
            for row in range(batch.num_rows):
                ids, decoded = coder.both(texts[row].as_py() or "")
                sizes.append(ids.count(",") + 1 if ids else 0)
                of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                of_texts.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(of_ids), pa.array(of_texts)], schema=schema
            )

    narrow = docs.select(F.col("doc_id").cast("bigint"), "text")
    return narrow.mapInArrow(rows, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
