"""SentencePiece encoding and decoding: one pass of an Aho-Corasick automaton drives a Viterbi search.

The automaton is made of all normal pieces' UTF-8 bytes, as a dense table (state, byte) -> state; a state's output links are the pieces
that end there, longest first.  Reading a byte, each output link of the state relaxes the best score at this position; so every match
is met once and the best segmentation is known at the end of the pass.  A character that no piece covers costs ``unknown`` and becomes
its bytes' pieces.

Words repeat, and no piece holds a word start after another character, so a batch's distinct words are searched together, in lockstep:
position by position, numpy moves all words' states and follows all output links.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, tokenizer_path

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
KEPT_WORDS = 400_000
#: Cells (words times bytes) that a lockstep holds at once.
CELLS = 1 << 20


class Automaton:
    """pieces: (bytes, score, id); byte_ids: the id of each byte's piece."""

    def __init__(self, pieces: list[tuple[bytes, float, int]], byte_ids: np.ndarray, unknown: float):
        children: list[dict[int, int]] = [{}]
        depth, out_id, out_score = [0], [-1], [0.0]
        for text, score, i in pieces:
            node = 0
            for b in text:
                to = children[node].get(b)
                if to is None:
                    to = children[node][b] = len(children)
                    children.append({})
                    depth.append(depth[node] + 1)
                    out_id.append(-1)
                    out_score.append(0.0)
                node = to
            if out_id[node] < 0 or score > out_score[node]:
                out_id[node], out_score[node] = i, score
        n = len(children)
        self.goto = np.zeros((n, 256), np.int32)
        fail, link = np.zeros(n, np.int32), np.zeros(n, np.int32)  # link: the next output on the suffix path, 0 for none
        level = [0]
        while level:
            following = []
            for node in level:
                row = self.goto[node]
                if node:
                    f = fail[node]
                    row[:] = self.goto[f]
                    link[node] = f if out_id[f] >= 0 else link[f]
                for b, to in children[node].items():
                    fail[to] = row[b] if node else 0
                    row[b] = to
                    following.append(to)
            level = following
        self.size, self.id, self.score, self.link = np.array(depth, np.int32), np.array(out_id, np.int32), np.array(out_score), link
        self.first = np.where(self.id >= 0, np.arange(n, dtype=np.int32), link)
        self.byte_ids, self.unknown = byte_ids, unknown

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The best segmentation of each word (valid UTF-8)."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(words[order[end]]) <= CELLS:
                end += 1
            part = order[at:end][::-1]
            for k, ids in zip(part, self._lockstep([words[k] for k in part]), strict=True):
                out[k] = ids
            at = end
        return out

    def _lockstep(self, words: list[bytes]) -> list[list[int]]:
        """words in order of decreasing length"""
        n, longest = len(words), len(words[0]) if words else 0
        size = np.array([len(w) for w in words])
        text = np.zeros((n, longest + 1), np.uint8)
        text[np.repeat(np.arange(n), size), np.concatenate([np.arange(s) for s in size]) if longest else np.zeros(0, int)] = np.frombuffer(b"".join(words), np.uint8)
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((longest + 1, n), np.int32)  # the node of the last piece, or minus the bytes of an unknown character
        state = np.zeros(n, np.int32)
        started = np.zeros(n, np.int64)  # where the current character begins
        for t in range(longest):
            live = int(np.searchsorted(-size, -t, side="left"))  # words longer than t
            b = text[:live, t]
            state = self.goto[state[:live], b]
            new = (b & 0xC0) != 0x80
            started = np.where(new, t, started[:live])
            rows, node = np.arange(live), self.first[state]
            rows, node = rows[node > 0], node[node > 0]
            while len(rows):
                score = best[t + 1 - self.size[node], rows] + self.score[node]
                better = score > best[t + 1, rows]
                best[t + 1, rows[better]], back[t + 1, rows[better]] = score[better], node[better]
                node = self.link[node]
                rows, node = rows[node > 0], node[node > 0]
            whole = (text[:live, t + 1] & 0xC0) != 0x80
            score = best[started, np.arange(live)] + self.unknown
            worse = np.flatnonzero(whole & (score > best[t + 1, :live]))
            best[t + 1, worse], back[t + 1, worse] = score[worse], started[worse] - (t + 1)
        out = []
        for k, w in enumerate(words):
            ids, t = [], len(w)
            while t:
                node = int(back[t, k])
                if node > 0:
                    ids.append(int(self.id[node]))
                    t -= int(self.size[node])
                else:
                    ids += self.byte_ids[np.frombuffer(w[t + node : t], np.uint8)][::-1].tolist()
                    t += node
            out.append(ids[::-1])
        return out


@lru_cache(2)
def model(name: str = "piece_bpe_32k.model"):
    """(automaton, piece texts by id): the file's pieces and scores; nothing is trained."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    normal, byte_ids, texts = [], np.zeros(256, np.int64), []
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            texts.append(bytes([int(text[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            texts.append(b"")
        else:
            if SPACE in text.lstrip(SPACE):
                raise ValueError("a piece holds a word start after another character")
            normal.append((text.encode(), sp.get_score(i), i))
            texts.append(text.replace(SPACE, " ").encode())
    # single signs and runs of spaces that the file excludes from merges (-1e9) cost as much as its last piece
    least = min(s for _, s, _ in normal if s > -1e8)
    normal = [(t, max(s, least), i) for t, s, i in normal]
    return Automaton(normal, byte_ids, least - 10.0), texts


_kept: dict[bytes, list[int]] = {}


def encode(texts: list[str | None], name: str = "piece_bpe_32k.model") -> list[list[int]]:
    """Ids of whole texts; as the format has it, a space is put before a text that isn't empty."""
    automaton, _ = model(name)
    if len(_kept) > KEPT_WORDS:
        _kept.clear()
    parts = [_WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    news = [w for w in set().union(*parts) if w not in _kept]
    _kept.update(zip(news, automaton.encode_words([w.encode("utf-8") for w in news]), strict=True))
    return [[i for w in p for i in _kept[w]] for p in parts]


def decode(ids: list[int], name: str = "piece_bpe_32k.model") -> str:
    """The text of ids; decode(encode(text)) is text, but where text itself holds the word-start sign."""
    texts = model(name)[1]
    return b"".join(texts[i] for i in ids).decode("utf-8", "replace")[1:]


def encode_documents(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, ids) of every row; null and empty texts have no ids.

    Repeated rows get a row each; an empty table gives none; extra columns are ignored.
    """

    def run(ids, texts):
        return {"doc_id": ids, "ids": encode(texts, name)}

    return map_texts(docs, run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded): the ids' number and crc32 (little-endian unsigned 32-bit), and whether decoding gives the text again."""

    def run(ids, texts):
        out = {"doc_id": ids, "n_pieces": [], "ids_crc32": [], "decoded": []}
        for text, got in zip(texts, encode(texts, name), strict=True):
            out["n_pieces"].append(len(got))
            out["ids_crc32"].append(zlib.crc32(np.array(got, "<u4").tobytes()))
            out["decoded"].append(decode(got, name) == (text or ""))
        return out

    return map_texts(docs, run, "doc_id long, n_pieces long, ids_crc32 long, decoded boolean")
