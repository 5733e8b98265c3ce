"""SentencePiece BPE encoding by a table of prefixes, and decoding.

In a merge-type model each prefix of a text has one encoding, so it has one last piece. A
table stores that piece for every prefix: among the vocabulary pieces that end there, found
by an Aho-Corasick automaton, it is the one that is compatible with the last piece of the
prefix before it, that is, merging both pieces' characters yields just this pair. The
pieces are then read off the table from the end of the text backwards. The work is linear
in the text, where applying merges takes n log n with a queue.

No piece continues past a word's end, so a text falls into independent segments: runs of
spaces with the word after them, cut also around characters that are in no piece. Segments
repeat, so two bounded tables of finished segments answer most of them: when the younger one
is full it becomes the older one, which is dropped, and what is still used moves over.

Edge cases: a null or empty text has no pieces and decodes to the empty text. Characters
outside the vocabulary become byte pieces. A very long text is cut into segments like any other; one
very long segment takes time and memory in proportion to it. Rows without a doc_id are no documents. An empty
table gives an empty result. Other columns are ignored; repeated rows are each encoded.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gossamer.llm.common import id_and_text, map_arrow, texts

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Finished segments in each of a worker's two tables, bits of a slot in its table of pairs. No result depends on them.
KEPT, PAIR_BITS, MIX = 300_000, 21, 0x9E3779B97F4A7C15
#: Signs that may close a word.
SIGNS = "!#$%&*,.:;?"
#: Longer segments are encoded one at a time and not kept. Texts whose segments are looked up together.
KEPT_LENGTH, TOGETHER = 64, 250

NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


class PieceCodec:
    """Encoder and decoder of one merge-type model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != trainer.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only merge-type models without normalization are read")
        if any(p.type == USER for p in model.pieces):
            raise ValueError("user-defined pieces are not read")
        self.dummy = spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.bytes_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        # pieces that merging can make, best first: equal scores merge left to right, so they share a rank
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, UNUSED)}
        scores = sorted({p.score for p in model.pieces}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        self.rank = {t: rank_of[model.pieces[i].score] for t, i in ids.items()}
        self.ids = ids
        self.splits = self._splits()
        self.automaton = ahocorasick.Automaton()
        for t in self.splits:
            self.automaton.add_word(t, ids[t] << 8 | len(t))
        self.automaton.make_automaton()
        if len(self.pieces) > 1 << 16 or max(map(len, self.splits)) > 255 or any("\n" in t[1:] for t in self.splits):
            raise ValueError("ids of over 16 bits, very long pieces and pieces across lines are not read")
        self.alphabet = {c for t in self.splits for c in t}
        # a text may be cut between two characters that stand together in no piece
        pairs = {t[i : i + 2] for t in self.splits for i in range(len(t) - 1)}
        if any(b == SPACE and a != SPACE for a, b in pairs):
            raise ValueError("a piece continues past a word's end")
        self.others = re.compile(f"[{''.join(map(re.escape, sorted(self.alphabet)))}]+|.", re.DOTALL)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        # so a word's closing signs are a segment of their own, where no piece joins a letter and a sign
        signs = [c for c in SIGNS if not any((a == c and b.isalpha()) or (b == c and a.isalpha()) for a, b in pairs)]
        self.closing = re.compile(f"(?<=[^\\W\\d_])[{re.escape(''.join(signs))}]+$") if signs else re.compile("(?!)")
        #: the last pair of pieces (left * 2^16 + right) of each slot, and whether it is compatible; ids (16 bits each) of finished segments
        self.pairs, self.fits = np.full(1 << PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << PAIR_BITS, dtype=bool)
        self.done: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.plain = [self._plain(i) for i in range(len(self.pieces))]

    # -- the vocabulary -------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short text by applying the merges themselves; a character in no piece stays alone."""
        parts = list(text)
        while True:
            best = min(
                ((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank),
                default=None,
            )
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _splits(self) -> dict[str, tuple[str, str] | None]:
        """For each piece that merging can reach, the two pieces of its last merge (None for a character)."""
        found: dict[str, tuple[str, str] | None] = {}
        for t in sorted(self.ids, key=len):
            if len(t) == 1:
                found[t] = None
                continue
            parts = list(t)
            while len(parts) > 2:
                best = min(
                    ((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank),
                    default=None,
                )
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 2:
                found[t] = (parts[0], parts[1])
        return found

    def _compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of ``left`` and ``right`` together yields just these two.

        The merges are undone from the latest: at each point in time the pieces on both
        sides of the seam are known, and a merge across it must not have come first.
        """
        rank, splits = self.rank, self.splits
        later = None  # (rank, side) of the merge that made a piece at the seam; None: the end of merging
        while True:
            across = rank.get(left + right)
            if across is not None:
                # it would win if it ranks before that merge; of equal ranks the one further left wins
                if later is None or across < later[0] or (across == later[0] and later[1] == 1):
                    return False
            a = (rank[left], 0) if splits[left] else None
            b = (rank[right], 1) if splits[right] else None
            if a is None and b is None:
                return True
            # the later of the two last merges: higher rank, of equal ranks the one on the right
            if b is None or (a is not None and a > b):
                later, left = a, splits[left][1]
            else:
                later, right = b, splits[right][0]

    # -- encoding -------------------------------------------------------

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(MIX) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def _fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair is compatible; pairs that are in no slot are tested once."""
        slots = self._slots(pairs)
        out = self.fits[slots]
        unknown = np.nonzero(self.pairs[slots] != pairs)[0]
        if len(unknown):
            new, at = np.unique(pairs[unknown], return_inverse=True)
            found = np.array([self._compatible(self.pieces[p >> 16], self.pieces[p & 0xFFFF]) for p in new.tolist()], dtype=bool)
            out[unknown] = found[at]
            slots, last = np.unique(self._slots(new), return_index=True)
            self.pairs[slots], self.fits[slots] = new[last], found[last]
        return out

    def _known(self, runs: list[str]) -> list[bytes]:
        """Packed ids of runs of characters that are all in the vocabulary, all prefixes of one length at a time."""
        lengths = np.array([len(r) for r in runs])
        base = np.concatenate([[0], np.cumsum(lengths + 1)])
        matches = np.fromiter(chain.from_iterable(self.automaton.iter("\n".join(runs))), dtype=np.int64).reshape(-1, 2)
        run_of = np.repeat(np.arange(len(runs)), lengths + 1)[matches[:, 0]]
        piece, size = matches[:, 1] >> 8, matches[:, 1] & 0xFF
        # the place behind a prefix of k characters of run r is base[r] + k
        place = matches[:, 0] + 1
        inside = place - base[run_of]
        order = np.argsort(inside.astype(np.uint16) if lengths.max() < 1 << 16 else inside, kind="stable")
        cuts = np.searchsorted(inside[order], np.arange(1, lengths.max() + 2))
        last, length = np.full(base[-1] + 1, -1, dtype=np.int64), np.zeros(base[-1] + 1, dtype=np.int64)
        for k in range(1, lengths.max() + 1):
            at = order[cuts[k - 1] : cuts[k]]
            at = at[inside[at] <= lengths[run_of[at]]]
            first = size[at] == k
            left = last[place[at] - size[at]]
            fits = first.copy()
            later = np.nonzero(~first & (left >= 0))[0]
            if len(later):
                fits[later] = self._fit(left[later] << 16 | piece[at[later]])
            chosen = at[fits]
            last[place[chosen]], length[place[chosen]] = piece[chosen], size[chosen]
        # read back from the ends
        runs_left, ends = np.arange(len(runs)), base[:-1] + lengths
        found, of = [], []
        while len(runs_left):
            if (last[ends] < 0).any():
                raise AssertionError("no piece ends a prefix")
            found.append(last[ends])
            of.append(runs_left)
            ends = ends - length[ends]
            more = ends > base[runs_left]
            runs_left, ends = runs_left[more], ends[more]
        steps = np.repeat(np.arange(len(found)), [len(x) for x in found])
        ids, of = np.concatenate(found), np.concatenate(of)
        raw = ids[np.lexsort((-steps, of))].astype("<u2").tobytes()
        bounds = (2 * np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(runs)))])).tolist()
        return [raw[i:j] for i, j in zip(bounds, bounds[1:])]

    def _learn(self, segments: list[str], table: dict[str, bytes]) -> None:
        """Put the packed ids of segments into the table."""
        ends = {s: m.start() for s in segments if (m := self.closing.search(s))}
        parts = {x for s, i in ends.items() for x in (s[:i], s[i:])}
        parts = parts.union(s for s in segments if s not in ends).difference(table)
        short = [s for s in parts if len(s) <= KEPT_LENGTH and self.alphabet.issuperset(s) and s != "\n"]
        if short:
            table.update(zip(short, self._known(short)))
        for s in parts.difference(short):
            table[s] = b"".join(
                self._known([p])[0] if p[0] in self.alphabet else np.array([self.bytes_ids.get(b, self.unknown) for b in p.encode()], dtype="<u2").tobytes()
                for p in self.others.findall(s)
            )
        for s, i in ends.items():
            table[s] = table[s[:i]] + table[s[i:]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, 16 bits each, little-endian."""
        out: list[bytes] = []
        mark = SPACE if self.dummy else ""
        for k in range(0, len(texts), TOGETHER):
            split = [self.segments.findall(mark + t.replace(" ", SPACE)) if t else [] for t in texts[k : k + TOGETHER]]
            used = set().union(*split)
            table, old = self.done
            if len(table) + len(used) > KEPT:
                self.done = table, old = {}, table
            new = []
            for s in used.difference(table):
                ids = old.get(s)
                if ids is None:
                    new.append(s)
                else:
                    table[s] = ids
            self._learn(new, table)
            out += [b"".join([table[s] for s in segments]) for segments in split]
            for s in new:
                if len(s) > KEPT_LENGTH:
                    del table[s]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], dtype="<u2").tolist()

    # -- decoding -------------------------------------------------------

    def _plain(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        if self.kinds[i] == UNKNOWN:
            return " ⁇ ".encode()
        return self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that form no character become U+FFFD, one for each."""
        plain = self.plain
        raw = b"".join([plain[i] for i in ids])
        first = next((i for i in ids if self.kinds[i] != CONTROL), None) if self.dummy else None
        if first is not None and self.pieces[first].startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)


def _lenient(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_LOADED: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The codec of a model file, built once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(path)
    return _LOADED[path]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every document."""

    def run(batches):
        own = codec(path or model_path())
        for batch in batches:
            ids = [np.frombuffer(x, dtype="<u2").tolist() for x in own.encode_batch([t.decode() for t in texts(batch, 1)])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return map_arrow(id_and_text(docs), run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; ``with_ids`` adds the ids themselves."""

    def run(batches):
        own = codec(path or model_path())
        number = [str(i) for i in range(len(own.pieces))]
        for batch in batches:
            counts, of_ids, of_text, packed = [], [], [], own.encode_batch([t.decode() for t in texts(batch, 1)])
            for raw in packed:
                ids = np.frombuffer(raw, dtype="<u2").tolist()
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join([number[i] for i in ids]).encode()).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = np.frombuffer(b"".join(packed), dtype="<u2").astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(id_and_text(docs), run, schema + (", ids array<int>" if with_ids else ""))


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
