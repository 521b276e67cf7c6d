"""Operator 4: SentencePiece encoding with byte spans, and decoding.

Texts are normalised as the model's specification says, many at a time: from
each place the longest prefix that the compiled character map holds is
replaced, white space is treated, and every byte made keeps the place in the
text that it came from. The library encodes the normalised text, and each
piece's bytes are projected through that alignment to the bytes of the
original text. An empty map is a map without prefixes and takes the same way.

Pieces of many models never hold a blank after another character. Then the
normalised texts are cut into units before blanks and around characters that
are in no longer piece, units with equal bytes are encoded once, and the
library sees no text twice. Other models are given normalised texts whole.
Results equal the library's in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import giving_back, read_table, slices, small_batches, text_buffer
from driftline.llm.hashing import distinct_spans

SPACE = "▁"
_SPACE = SPACE.encode()
#: Bytes of units that a task remembers; beyond it the memory starts anew.
REMEMBERED = 2 << 20
BATCH_BYTES = 1 << 19


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 prefixes, and the strings that replace them."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.cells = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64) if size else np.empty(0, np.int64)
        self.strings = blob[4 + size :]

    def longest(self, buf: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the longest prefix of buf[at:end] in the map, for each place: its length (0 if there is none), and where its replacement is."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if not len(self.cells):
            return length, value
        below = lambda cell: (cell >> 10) << ((cell & 512) >> 6)
        live, depth = np.arange(len(at)), 0
        node = np.full(len(at), int(below(self.cells[0])))
        while len(live):
            more = at[live] + depth < ends[live]
            live, node = live[more], node[more]
            byte = buf[at[live] + depth].astype(np.int64)
            node = node ^ byte
            cell = self.cells[np.minimum(node, len(self.cells) - 1)]
            there = (node < len(self.cells)) & (cell & 0x800000FF == byte)
            live, node, cell = live[there], node[there], cell[there]
            node = node ^ below(cell)
            depth += 1
            leaf = cell & 256 > 0
            length[live[leaf]] = depth
            value[live[leaf]] = self.cells[node[leaf]] & 0x7FFFFFFF
        return length, value

    def string(self, value: int) -> bytes:
        return self.strings[value : self.strings.index(b"\0", value)]


class PieceModel:
    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb2

        with open(path, "rb") as f:
            self.model = f.read()
        proto = pb2.ModelProto()
        proto.ParseFromString(self.model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.collapse, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        kinds = np.array([p.type for p in proto.pieces])
        made = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type in (1, 4, 5) else b"" for p in proto.pieces]
        self.byte_size = np.array([len(x) for x in made])
        self.byte_at = np.cumsum(self.byte_size) - self.byte_size
        self.byte_data = np.frombuffer(b"".join(made), np.uint8)
        self.normal_size = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces])
        longer = [p.piece for p in proto.pieces if p.type in (1, 4) and len(p.piece) > 1]
        held = set("".join(longer))
        self.alone = np.array([c < 128 and chr(c) not in held for c in range(256)])
        self.by_unit = proto.trainer_spec.byte_fallback and self.escape and not self.suffix and 4 not in kinds and not any(a != SPACE and b == SPACE for x in longer for a, b in zip(x, x[1:], strict=False))
        # Decoding leaves out the one blank that encoding puts first.
        self.plain_decoding = self.by_unit and self.dummy and not self.collapse
        # The same pieces without normalisation: what it is given is normalised already.
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.forget()

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.size = 0
        self.at, self.ids = np.zeros(1, np.int64), np.empty(0, np.int32)

    def normalize(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The normalised bytes of all texts and each text's offsets among them; the place in buf that each byte was made from, and for each text the place where its last piece ends."""
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        width = np.diff(np.append(lead, len(buf)))
        doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(lead, off)))
        match, value = self.map.longest(buf, lead, off[doc + 1])
        passed = np.zeros(len(lead), bool)
        for k in np.flatnonzero(match > width).tolist():  # prefixes of several characters
            if not passed[k]:
                passed[k + 1 : np.searchsorted(lead, lead[k] + match[k])] = True
        if passed.any():
            lead, width, doc, match, value = (x[~passed] for x in (lead, width, doc, match, value))
        mapped = match > 0
        made, which = np.unique(value[mapped], return_inverse=True)
        strings = [self.map.string(x) for x in made.tolist()]
        string_at = np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype(np.int64)
        size, source = width.copy(), lead.copy()
        size[mapped] = np.diff(string_at)[which]
        source[mapped] = len(buf) + string_at[:-1][which]
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(lead)), size)
        within = np.arange(len(of)) - first[of]
        data = np.concatenate([buf, np.frombuffer(b"".join(strings), np.uint8)])[source[of] + within]
        origin = lead[of] + np.where(mapped[of], 0, within)
        owner = doc[of]
        if self.collapse:
            solid = np.concatenate([[0], np.cumsum(data != 32)])
            leading = (data == 32) & (solid[:-1] == solid[first[of]])
            start = first[of]
            after = (start == 0) | (owner[start - 1] != owner) | (data[start - 1] == 32)
            kept = ~(leading & after)
            data, origin, owner = data[kept], origin[kept], owner[kept]
        full = np.flatnonzero(np.diff(off) > 0)
        some = full[np.isin(full, owner)] if self.collapse else full
        stop = off[1:].copy()
        if self.dummy:
            edge = np.searchsorted(owner, full, "right" if self.suffix else "left")
            near = np.searchsorted(owner, full, "left")
            begin = np.where(np.searchsorted(owner, full, "right") > near, origin[np.minimum(near, max(len(origin) - 1, 0))] if len(origin) else 0, off[full + 1])
        if self.dummy and not self.suffix:
            data, origin, owner = np.insert(data, edge, 32), np.insert(origin, edge, begin), np.insert(owner, edge, full)
        blank = data == 32
        if self.escape:
            wide = np.where(blank, len(_SPACE), 1)
            of = np.repeat(np.arange(len(data)), wide)
            new = np.arange(len(of)) - (np.cumsum(wide) - wide)[of]
            data = np.where(blank[of], np.frombuffer(_SPACE, np.uint8)[np.minimum(new, 2)], data[of])
            origin, owner = origin[of], owner[of]
            blank = self._blanks(data)
        if self.collapse:
            last = np.full(len(off) - 1, -1)
            last[owner[~blank]] = np.flatnonzero(~blank)
            kept = np.arange(len(data)) <= last[owner]
            gone = np.flatnonzero(~kept)[::-1]
            stop[owner[gone]] = origin[gone]  # the first of each stays
            data, origin, owner = data[kept], origin[kept], owner[kept]
        if self.dummy and self.suffix:
            edge = np.searchsorted(owner, some, "right")
            for byte in _SPACE if self.escape else b" ":
                data, origin, owner = np.insert(data, edge, byte), np.insert(origin, edge, stop[some]), np.insert(owner, edge, some)
                edge = edge + np.arange(1, len(some) + 1)
        return data, np.searchsorted(owner, np.arange(len(off))), origin, stop

    @staticmethod
    def _blanks(data: np.ndarray) -> np.ndarray:
        """Which bytes are of a visible blank."""
        out = np.zeros(len(data), bool)
        at = np.flatnonzero((data[:-2] == _SPACE[0]) & (data[1:-1] == _SPACE[1]) & (data[2:] == _SPACE[2])) if len(data) > 2 else np.empty(0, np.int64)
        for k in range(3):
            out[at + k] = True
        return out

    def _learn(self, texts: list[bytes]) -> None:
        """texts: new units, each once."""
        ids = self.plain.encode([t.decode() for t in texts], num_threads=1)
        self.slots.update(zip(texts, range(len(self.at) - 1, len(self.at) - 1 + len(texts)), strict=True))
        self.size += sum(map(len, texts))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in ids])])
        self.ids = np.concatenate([self.ids, np.array([i for x in ids for i in x], np.int32)])

    def _by_unit(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blank = self._blanks(data)
        blank[1:] &= data[1:] == _SPACE[0]
        blank[:1] &= data[:1] == _SPACE[0]
        alone = self.alone[data]
        first = blank | alone
        first[3:] &= ~(blank[3:] & blank[:-3])  # blanks in a row stay together
        first[1:] |= alone[:-1]
        first[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        lead, which = distinct_spans(data, starts, ends)
        if self.size > REMEMBERED:
            self.forget()
        raw = data.tobytes()
        texts = [raw[s:e] for s, e in zip(starts[lead].tolist(), ends[lead].tolist(), strict=True)]
        new = list({t: None for t in texts if t not in self.slots})
        if new:
            self._learn(new)
        slot = np.array([self.slots[t] for t in texts], np.int64)[which]
        length = self.at[slot + 1] - self.at[slot]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.at[slot] - total[:-1], length)]
        return ids, total[np.searchsorted(starts, off)], self.normal_size[ids]

    def _whole(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            text = data[a:b].tobytes().decode()
            own = self.plain.encode(text)
            ids.append(own)
            if self.plain.unk_id() in own:  # an unknown piece is as long as what it stands for
                sizes.append([len(p.surface.encode()) for p in self.plain.encode(text, return_type="proto").pieces])
            else:
                sizes.append(self.normal_size[own].tolist() if own else [])
        flat = lambda x: np.array([v for y in x for v in y], np.int64)
        return flat(ids).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), flat(sizes)

    def _decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        if not self.plain_decoding:
            return pa.array([self.library.decode(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
        length = self.byte_size[ids]
        total = np.concatenate([[0], np.cumsum(length)])
        made = self.byte_data[np.arange(total[-1]) + np.repeat(self.byte_at[ids] - total[:-1], length)]
        edge = total[at]
        drop = np.diff(edge) > 0
        keep = np.ones(len(made), bool)
        keep[edge[:-1][drop]] = False
        text_at = edge - np.concatenate([[0], np.cumsum(drop)])
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(text_at.astype(np.int64).tobytes()), pa.py_buffer(made[keep].tobytes())).cast(pa.string())

    def encode(self, column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
        """Of each text (null: empty): ids, begins and ends as lists, and the text that they decode to."""
        buf, off = text_buffer(column)
        data, at, origin, stop = self.normalize(buf, off)
        ids, piece_at, size = (self._by_unit if self.by_unit else self._whole)(data, at)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(piece_at))
        ends = np.cumsum(size)
        begin = origin[np.minimum(ends - size, max(len(origin) - 1, 0))] if len(ids) else ends
        end = np.where(ends < at[doc + 1], origin[np.minimum(ends, len(origin) - 1)], stop[doc]) if len(ids) else ends
        lists = [pa.ListArray.from_arrays(pa.array(piece_at.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, begin - off[doc], end - off[doc])]
        return (*lists, self._decode(ids, piece_at))


_made: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The worker's own, without the units of earlier tasks; the library's part, which does not grow, is read once."""
    if path not in _made:
        _made[path] = PieceModel(path)
    _made[path].forget()
    return _made[path]


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, begins, ends: ARRAY<INT>, decoded STRING) of every row of docs (doc_id, text).

    begins and ends are byte offsets in the text's UTF-8, end exclusive. What
    normalisation adds (the blank put first) is at no bytes. A null or empty
    text has no pieces and decodes to an empty text. Rows are independent:
    null doc_ids, ties and repeated rows come out as they stand.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            for piece in slices(batch, limit=BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *model.encode(piece.column("text"))], ["doc_id", "ids", "begins", "ends", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, begins array<int>, ends array<int>, decoded string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: F.sha2(x, 256)
    covered = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"), covered.alias("span_bytes"))
