"""SentencePiece encoding by a table of distinct chunks, and decoding.

Where no piece of the model holds a white-space marker after another character, no
merge can cross the start of a marker run. A text then splits into chunks, a run of
markers with the word behind it, that are segmented independently: each distinct chunk
goes through the library once per task and a text's ids are joined from the table by
position. A model without that property encodes whole texts as single chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

#: A task's table of distinct chunks is emptied when it holds about this many bytes.
TABLE_BYTES = 128 << 20
#: Texts are split together up to this many characters.
TOGETHER = 1 << 20
_MARK = "▁"
#: A chunk starts at a marker or space that follows another character.
_CHUNK = re.compile(rf"(?:^|[ {_MARK}])[ {_MARK}]*[^ {_MARK}]*")


def splits_at_markers(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether the model keeps white space as it is and no piece crosses a marker's start."""
    if any(re.search(f"[^{_MARK}]{_MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size())):
        return False
    if any(not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and " " in model.id_to_piece(i) for i in range(model.get_piece_size())):
        return False
    probe = "  a  b\t c\n d  "
    return model.decode(model.encode(probe)) == probe and model.id_to_piece(model.encode("a")[0]).startswith(_MARK)


Encoded = tuple[int, str, str]


class Codec:
    """Encodes and decodes whole texts through a table of distinct chunks."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_chunk = splits_at_markers(self.model)
        self.end, self.mark = self.model.eos_id(), self.model.piece_to_id(_MARK)
        self.pieces = [self._bytes(i) for i in range(self.model.get_piece_size())]
        self.table: dict[str, Encoded] = {}
        self.held = 0

    def _bytes(self, i: int) -> bytes:
        """What a piece adds to the decoded text."""
        if self.model.is_control(i):
            return b""
        if self.model.is_unknown(i):
            return " \u2047 ".encode()
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(_MARK, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, with the leading marker's space."""
        return b"".join([self.pieces[i] for i in ids]).decode("utf-8", "replace")

    def _segment(self, chunks: list[str]) -> list[Encoded]:
        """Number of ids, their decimals and their text, for chunks with their marker.

        The library puts a marker before every text, so the chunk's own is left out.
        """
        found = self.model.encode([c[1:] for c in chunks], num_threads=1)
        for i, c in enumerate(chunks):
            if len(c) == 1:
                found[i] = [self.mark]
        return [(len(ids), " ".join(map(str, ids)), self.decode(ids)) for ids in found]

    def encode(self, texts: list[str]) -> list[Encoded]:
        """(number of ids, decimals joined by spaces, decoded text) of each, with the end id."""
        if not self.by_chunk:
            found = [self.model.encode(t, num_threads=1) for t in texts]
            return [(len(ids) + 1, " ".join(map(str, [*ids, self.end])), self.model.decode(ids)) for ids in found]
        # With a space in front the first chunk has its marker like all others.
        split = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        table = self.table
        missing = [c for c in set().union(*split) if c not in table]
        if self.held > TABLE_BYTES:
            table.clear()
            self.held, missing = 0, list(set().union(*split))
        table.update(zip(missing, self._segment(missing), strict=True))
        self.held += sum(300 + 12 * len(c) for c in missing)
        out = []
        for chunks in split:
            entries = [table[c] for c in chunks]
            decimals = " ".join([*[e[1] for e in entries], str(self.end)])
            out.append((sum([e[0] for e in entries]) + 1, decimals, "".join([e[2] for e in entries])[1:]))
        return out

    def encode_all(self, texts: list[str]) -> Iterator[Encoded]:
        """As encode, a bounded number of characters (or one text) at a time."""
        start, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size > TOGETHER or i == len(texts) - 1:
                yield from self.encode(texts[start : i + 1])
                start, size = i + 1, 0


def encode(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids as decimals joined by spaces, n_tokens, decoded) of every whole text.

    Ids are those of the library with an end id and without sampling. Null counts as
    empty: the end id alone. Equal texts have equal ids; an empty table gives no rows.
    The model's file is read on the driver, is bounded and goes to every task.
    """
    return _coded(documents, model_path, id_col, text_col, digest=False)


def digests(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode, with SHA-256 of the decimals and of the decoded text in their place."""
    return _coded(documents, model_path, id_col, text_col, digest=True)


def _coded(documents: DataFrame, model_path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    with open(model_path, "rb") as file:
        model = documents.sparkSession.sparkContext.broadcast(file.read())

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for n, decimals, surface in codec.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(n)
                ids.append(sha(decimals) if digest else decimals)
                decoded.append(sha(surface) if digest else surface)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids string, decoded string")
    return rows.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"}) if digest else rows
