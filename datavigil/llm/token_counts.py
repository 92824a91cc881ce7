"""Operator 6: token counts that follow edits without encoding a whole document again.

The pre-tokens of a document are the leaves of a segment tree (runs of up to 32 pre-tokens per leaf) whose nodes hold the
number of characters and of tokens below them. An edit finds its place by the character sums, cuts the text again only
from the last pre-token that the edit cannot have touched up to the first old boundary that the new cut meets again,
encodes the pre-tokens in between and updates the sums on the way up. Trees are a column that edits take in and give out, so
a further batch of edits costs what it touches. Everything happens per document, so no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datavigil.llm import arrays as A
from datavigil.llm import pretokens as P
from datavigil.llm.bpe import _spread

#: Characters behind its end that a match of the pattern may have looked at (an apostrophe looks at two more).
CONTEXT = 3
LEAF = 32
BLOCK_CHARS = 1 << 22
KNOWN_WORDS = 1 << 19
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
                                  T.StructField("new", T.StringType())]))


class CountTree:
    """Sums of characters and tokens over the pre-tokens of one text, kept right under edits.

    A leaf holds LEAF pre-tokens at most. An edit that makes more of them than its leaves hold adds leaves, and the sums above
    are laid out anew, which happens once in many edits. Leaves of a loaded tree are cut out of the text only when touched.
    """

    def __init__(self, pieces: list[str], find, count):
        self.find, self.count, self.encoded = find, count, 0
        self.leaves: list = [pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self._lay([sum(map(len, leaf)) for leaf in self.leaves], [sum(map(count, leaf)) for leaf in self.leaves])

    @classmethod
    def load(cls, text: str, kept: dict, find, count) -> CountTree:
        """The tree of a text as `dump` gave it; nothing is cut or encoded."""
        tree = cls.__new__(cls)
        tree.find, tree.count, tree.encoded = find, count, 0
        tree.source, tree.lengths = text, P.unpack_numbers(kept["pieces"])
        sizes, tokens = P.unpack_numbers(kept["leaves"]), P.unpack_numbers(kept["tokens"])
        stops = np.cumsum(sizes)
        ends = np.concatenate(([0], np.cumsum(tree.lengths)))
        starts = stops - sizes
        tree.leaves = list(zip(ends[starts].tolist(), starts.tolist(), stops.tolist(), strict=True))
        tree._lay((ends[stops] - ends[starts]).tolist(), tokens.tolist())
        return tree

    def dump(self) -> dict:
        """The lengths of the pre-tokens, and how many of them and of tokens each leaf has, packed."""
        parts = [self.lengths[leaf[1]:leaf[2]] if isinstance(leaf, tuple) else np.fromiter(map(len, leaf), np.int64, len(leaf)) for leaf in self.leaves]
        count = len(self.leaves)
        return {"pieces": P.pack_numbers(np.concatenate(parts)), "leaves": P.pack_numbers(np.array([len(p) for p in parts])),
                "tokens": P.pack_numbers(np.array(self.tokens[self.size:self.size + count]))}

    def _lay(self, chars: list[int], tokens: list[int]) -> None:
        self.size = 1 << (len(chars) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size:self.size + len(chars)], self.tokens[self.size:self.size + len(tokens)] = chars, tokens
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def leaf(self, i: int) -> list[str]:
        own = self.leaves[i]
        if isinstance(own, tuple):
            at, low, high = own
            own = self.leaves[i] = []
            for n in self.lengths[low:high].tolist():
                own.append(self.source[at:at + n])
                at += n
        return own

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.source[leaf[0]:leaf[0] + self.chars[self.size + i]] if isinstance(leaf, tuple) else "".join(leaf)
                       for i, leaf in enumerate(self.leaves))

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character, and where it begins; the last leaf for the end of the text."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def replace(self, start: int, stop: int, new: str) -> None:
        """Characters start to stop (of the text as it is now) become new."""
        length = self.chars[1]
        start, stop = max(0, min(start, length)), max(0, min(stop, length))
        stop = max(start, stop)
        first, at = self._leaf_at(max(0, start - CONTEXT))
        first = min(first, len(self.leaves) - 1)
        skip, head = 0, self.leaf(first)
        while skip < len(head) and at + len(head[skip]) + CONTEXT <= start:
            at += len(head[skip])
            skip += 1
        last, wanted = first, stop + CONTEXT + 1
        old = head[skip:]
        end = at + sum(map(len, old))
        while True:
            while end < wanted and last + 1 < len(self.leaves):
                last += 1
                old += self.leaf(last)
                end += self.chars[self.size + last]
            whole = last + 1 >= len(self.leaves)
            text = "".join(old)
            fresh = self.find(text[:start - at] + new + text[stop - at:])
            met = self._meeting(old, fresh, at, stop, len(new) - (stop - start), end, whole)
            if met is not None:
                break
            wanted = end + (end - at) + 1  # no old boundary met again: twice as far
        keep, used = met
        self.encoded += used
        pieces = head[:skip] + fresh[:used] + old[keep:]
        count = last - first + 1
        if len(pieces) > count * LEAF:
            count = -(-len(pieces) // (LEAF * 3 // 4))
        share = -(-len(pieces) // count)
        leaves = [pieces[i * share:(i + 1) * share] for i in range(count)]
        chars, tokens = [sum(map(len, x)) for x in leaves], [sum(map(self.count, x)) for x in leaves]
        grown = count != last - first + 1
        self.leaves[first:last + 1] = leaves
        if grown:
            n = len(self.leaves) - count + last - first + 1  # leaves before
            old_chars, old_tokens = self.chars[self.size:self.size + n], self.tokens[self.size:self.size + n]
            self._lay(old_chars[:first] + chars + old_chars[last + 1:], old_tokens[:first] + tokens + old_tokens[last + 1:])
            return
        self.chars[self.size + first:self.size + last + 1] = chars
        self.tokens[self.size + first:self.size + last + 1] = tokens
        nodes = set(range((self.size + first) // 2, (self.size + last) // 2 + 1))
        while nodes and 0 not in nodes:
            for node in nodes:
                self._sum(node)
            nodes = {node // 2 for node in nodes} - {0}

    @staticmethod
    def _meeting(old, fresh, at, stop, shift, end, whole) -> tuple[int, int] | None:
        """How many old and new pre-tokens lie before the first boundary that both cuts have behind the edit."""
        ends = {at: 0} if at >= stop else {}
        place = at
        for i, piece in enumerate(old, 1):
            place += len(piece)
            if place >= stop:
                ends[place] = i
        place = at
        for j, piece in enumerate(["", *fresh]):
            place += len(piece)
            before = place - shift
            if before >= stop and before in ends and (before + CONTEXT <= end or whole):
                if not (j == 0 and shift):
                    return ends[before], j
        if whole:
            return len(old), len(fresh)
        return None


def redactions(docs: DataFrame, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """docs with edits_col: e-mail addresses become <mail> and runs of four or more digits <number>.

    An edit is (start, stop, new) in characters of the original text; edits are in order and do not overlap. A null text
    has no edits.
    """
    pattern = regex.compile(r"(?P<mail>[\w.%+-]++@[\w-]+(?:\.[\w-]+)+)|(?P<number>[0-9]{4,}+)")

    def run(batches):
        for batch in A.pieces(batches):
            column = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                column.append([{"start": m.start(), "stop": m.end(), "new": f"<{m.lastgroup}>"} for m in pattern.finditer(text or "")])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("new", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, kind)], [*batch.schema.names, "edits"])

    others = [c for c in docs.columns if c not in (text_col, edits_col)]
    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(f"`{text_col}`").alias("text"))
    out = safe.mapInArrow(run, T.StructType([*safe.schema.fields, T.StructField("edits", EDITS)]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], F.col("text").alias(text_col),
                      F.col("edits").alias(edits_col))


def _counter(ranks: dict[bytes, int]):
    known: dict[str, int] = {}

    def count(word: str) -> int:
        n = known.get(word)
        if n is None:
            if len(known) >= KNOWN_WORDS:
                known.clear()  # only what has been worked out is forgotten
            n = known[word] = len(P.merge(word.encode(), ranks))
        return n

    return count


def _with(docs: DataFrame, last: list[str], run, fields: str, replaced: list[str]) -> DataFrame:
    """docs through run, which gets the columns named in `last` behind all others and gives those others and new fields."""
    others = [c for c in docs.columns if c not in last and c not in replaced]
    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], *[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(last)])
    new = T.StructType.fromDDL(fields)
    schema = T.StructType([*safe.schema.fields[:len(others)], *new.fields])
    out = safe.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], *new.names)


TREE = "struct<pieces:binary,leaves:binary,tokens:binary>"
_TREE = pa.struct([("pieces", pa.binary()), ("leaves", pa.binary()), ("tokens", pa.binary())])


def trees(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """docs with `tree`, the segment tree of each text, and `n_tokens`. The text is kept, as edits need it.

    A tree is the lengths of the pre-tokens and, for each leaf, how many pre-tokens and tokens it has, about a byte for each
    pre-token. A null or empty text has an empty tree. Columns with these names are replaced.
    """
    spread = _spread(docs.sparkSession, ranks)

    def run(batches):
        count = _counter(spread.value)

        def counted(rows, texts, block):
            words, numbers, bounds = block.numbered()
            sizes = np.fromiter(map(count, words), np.int64, len(words))[numbers] if len(words) else np.empty(0, np.int64)
            lengths = np.fromiter(map(len, words), np.int64, len(words))[numbers] if len(words) else np.empty(0, np.int64)
            sums = np.concatenate(([0], np.cumsum(sizes)))
            many = np.maximum(-(-np.diff(bounds) // LEAF), 1)
            # the leaves of all texts of the block one after the other
            starts = np.repeat(bounds[:-1], many) + LEAF * A.ragged(np.zeros(len(many)), many)
            stops = np.minimum(starts + LEAF, np.repeat(bounds[1:], many))
            leaf_bounds = np.concatenate(([0], np.cumsum(many)))
            packed = [A.binary_array(*P.pack_ragged(x, b)) for x, b in (
                (lengths, bounds), (stops - starts, leaf_bounds), (sums[stops] - sums[starts], leaf_bounds))]
            return pa.RecordBatch.from_arrays([*rows, texts, pa.StructArray.from_arrays(packed, fields=list(_TREE)),
                                               pa.array(sums[bounds[1:]] - sums[bounds[:-1]])], names=[*names, text_col, "tree", "n_tokens"])

        for batch in A.pieces(batches):
            names = [f"c{i}" for i in range(batch.num_columns - 1)]
            _, offsets = A.byte_view(batch.column(batch.num_columns - 1))
            for i, j in A.slices(offsets, BLOCK_CHARS):
                own = batch.slice(i, j - i)
                block = P.Block(pattern)
                block.extend(own.column(own.num_columns - 1))
                yield counted(own.columns[:-1], own.columns[-1], block)

    return _with(docs, [text_col], run, f"`{text_col}` string, tree {TREE}, n_tokens bigint", ["tree", "n_tokens"])


def edit(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """docs, which have trees, with the edits made: text, `tree` and `n_tokens` afterwards, `n_edits`, and `n_encoded_again`,
    the number of pre-tokens that the edits made the tree encode. edits_col is gone.

    edits_col holds (start, stop, new) in characters of the text as it was, in order and without overlaps. Rows without edits
    are handed on unread; of others only the leaves that an edit touches are cut out and encoded. Null edits are none; places
    beyond the text are moved to its end, a null start or stop to the text's begin or to start, a null new is empty.
    """
    spread = _spread(docs.sparkSession, ranks)

    def run(batches):
        find, count = regex.compile(pattern).findall, _counter(spread.value)
        for batch in A.pieces(batches, 256):
            rows = batch.columns[:-4]
            text, tree, n_tokens, edits = (c.to_pylist() for c in batch.columns[-4:])
            n_edits, again = [len(e or ()) for e in edits], [0] * batch.num_rows
            for i, own in enumerate(edits):
                if not own:
                    continue
                kept, shift = CountTree.load(text[i] or "", tree[i], find, count), 0
                for e in own:
                    start = e["start"] or 0
                    stop = e["stop"] if e["stop"] is not None else start
                    length = kept.chars[1]
                    kept.replace(start + shift, stop + shift, e["new"] or "")
                    shift += kept.chars[1] - length
                text[i], tree[i], n_tokens[i], again[i] = kept.text(), kept.dump(), kept.total, kept.encoded
            yield pa.RecordBatch.from_arrays(
                [*rows, pa.array(text, pa.string()), pa.array(tree, _TREE), *(pa.array(x, pa.int64()) for x in (n_tokens, n_edits, again))],
                names=[*(f"c{i}" for i in range(len(rows))), text_col, "tree", "n_tokens", "n_edits", "n_encoded_again"])

    fields = f"`{text_col}` string, tree {TREE}, n_tokens bigint, n_edits bigint, n_encoded_again bigint"
    return _with(docs, [text_col, "tree", "n_tokens", edits_col], run, fields, ["n_edits", "n_encoded_again"])


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 edits_col: str = "edits") -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_encoded_again) per row: trees of the texts, and one batch of edits on
    them, see `edit`. A null text counts as empty. Repeated rows and null ids are counted as they come; an empty table gives
    no rows."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(edits_col).alias("edits"), F.col(text_col).alias("text"))
    built = trees(picked, ranks, pattern).withColumn("before", F.col("n_tokens"))
    return edit(built, ranks, pattern).select("doc_id", F.col("before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"), "n_encoded_again")
