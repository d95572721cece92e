"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of labelled texts. A text is parsed
greedily into the longest phrases that occur in the sample; the fewer phrases a language needs, the closer the
text is to it. The cost of a language is phrases x log2(sample length) / text length, an estimate of the
cross entropy in bits a symbol; the lowest cost wins, of equal costs the language first by code point.

Following an automaton from its root spells exactly the sample's substrings, so a parse needs transitions
only. They are laid out as one table in which a missing transition already leads to the start of the next
phrase. Texts are cut into pieces that take their steps together, each from the root at first. Then every piece is
parsed again from the state that the piece before it ends in, until both parses are in the same state, after which
they agree: the count is that of the greedy parse of the whole text. Prediction is map-only: no shuffle, nothing
depends on other rows.

Symbols are bytes of UTF-8 with A-Z and Latin-1 capitals lower-cased and runs of ASCII non-letters as one space.

Fitting learns from whole texts of a bounded number of rows: for each language rows in order of a hash of id and
text, at most ``sample_docs`` of them and as many as fit into ``sample_bytes`` together, or into an even share of
``total_bytes`` where languages are many. A row longer than that is passed over, unless a language has no other: then
its shortest row is taken. The driver gets these rows and one count for each language.

Defined cases: a null text or one without a letter is ``und`` with score 0 and no phrases; without any labelled text
every text is ``und``; with one language it always wins with score 1; rows that agree in id and text are learned from
once; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.llm.common import bound_batches, fields_of_row, release, whole_row

PIECE, BATCH_BYTES = 512, 1 << 20
FOUND = ("lang_pred", "score", "phrases", "bits")


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # byte -> symbol
    symbols: int
    table: np.ndarray  # 2 * (index of the next state's row) + (1 where a phrase ends)
    roots: np.ndarray
    bits: np.ndarray  # log2 of each sample's length


def symbols_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of concatenated texts, and where each text's now end."""
    low = data.copy()
    upper = (data >= 65) & (data <= 90)
    low[upper] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    latin = after & (data >= 0x80) & (data <= 0x9E)
    low[latin] += 32
    space = (low < 128) & ~((low >= 97) & (low <= 122))
    low[space] = 32
    first = np.zeros(len(data) + 1, bool)
    first[np.concatenate([[0], ends[:-1]])] = True
    doubled = np.zeros(len(data), bool)
    doubled[1:] = space[1:] & space[:-1]
    keep = ~(doubled | (space & first[:-1]))
    kept = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], kept[ends]


def automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of sample; state 0 is the root."""
    trans: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sample:
        here = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = here
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                copy = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    return trans


def build(samples: dict[str, bytes]) -> Model:
    seen = sorted(set().union(*samples.values())) if samples else []
    codes = np.zeros(256, np.int32)
    codes[seen] = np.arange(1, len(seen) + 1)  # 0: in no sample
    width, tables, roots, base = len(seen) + 1, [], [], 0
    languages = sorted(samples)
    for language in languages:
        trans = automaton(samples[language])
        root = np.zeros(width, np.int64)
        for c, q in trans[0].items():
            root[codes[c]] = q
        full = np.tile(2 * (base + root * width) + 1, (len(trans), 1))
        for s, row in enumerate(trans):
            for c, q in row.items():
                full[s, codes[c]] = 2 * (base + q * width)
        tables.append(full.ravel())
        roots.append(base)
        base += full.size
    kind = np.int32 if base < 1 << 30 else np.int64
    table = np.concatenate(tables).astype(kind) if tables else np.zeros(0, kind)
    return Model(languages, codes, width, table, np.array(roots, kind), np.log2([max(2, len(samples[x])) for x in languages]))


def phrases(model: Model, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Phrases each language needs for each text: an array of languages x texts."""
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    pieces = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    if not len(owner):
        return np.zeros((len(model.languages), len(sizes)), np.int64)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[owner] + inside * PIECE
    length = np.minimum(PIECE, sizes[owner] - inside * PIECE)
    coded = model.codes[np.concatenate([text, np.zeros(PIECE, np.uint8)])]
    grid = np.ascontiguousarray(coded[begin[:, None] + np.arange(PIECE)].T)
    breaks, state = _from_root(model, grid, length)
    more = _from_before(model, grid, length, inside, state)
    out = np.stack([np.bincount(owner, b + m, len(sizes)) for b, m in zip(breaks, more, strict=True)]).astype(np.int64)
    return out + (sizes > 0)


def _from_root(model: Model, grid: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often a phrase ends in each piece, and the state at its end, parsed from the root: languages x pieces."""
    order = np.argsort(-length, kind="stable")
    rows = grid[:, order]
    state = np.repeat(model.roots[:, None], len(order), axis=1)
    count = np.zeros(state.shape, np.int32)
    active = np.searchsorted(-length[order], -np.arange(PIECE), side="left")  # pieces longer than each step
    for step in range(int(length.max())):
        n = int(active[step])
        found = model.table.take(state[:, :n] + rows[step, :n])
        count[:, :n] += found & 1
        state[:, :n] = found >> 1
    back = np.argsort(order, kind="stable")
    return count[:, back], state[:, back]


def _from_before(model: Model, grid: np.ndarray, length: np.ndarray, inside: np.ndarray, root_end: np.ndarray) -> np.ndarray:
    """How many phrase ends more (or fewer) each piece has when its parse goes on from the piece before it."""
    more, end = np.zeros(root_end.shape, np.int64), root_end.copy()
    language, piece = (x.ravel() for x in np.meshgrid(np.arange(len(end)), np.flatnonzero(inside > 0), indexing="ij"))
    while len(piece):  # those whose start is not what it was taken for before
        plain, true = model.roots[language], end[language, piece - 1]
        gain = np.zeros(len(piece), np.int64)
        now = np.arange(len(piece))
        for step in range(PIECE):
            now = now[(plain[now] != true[now]) & (length[piece[now]] > step)]
            if not len(now):
                break
            symbol = grid[step, piece[now]]
            a, b = model.table.take(plain[now] + symbol), model.table.take(true[now] + symbol)
            gain[now] += (b & 1).astype(np.int64) - (a & 1)
            plain[now], true[now] = a >> 1, b >> 1
        apart = plain != true
        after = np.where(apart, true, root_end[language, piece])
        changed = after != end[language, piece]
        more[language, piece], end[language, piece] = gain, after
        follows = np.zeros(len(inside) + 1, bool)
        follows[:-1] = inside > 0
        changed &= follows[piece + 1]
        language, piece = language[changed], piece[changed] + 1
    return more


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, ends) of runs of texts; nulls are empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, side="right")) - 1)
        to = min(to, len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def classify(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: number of the language, score, phrases it needs in this language, bits a symbol."""
    best, score = np.zeros(len(column), np.int64), np.ones(len(column))
    needed, bits = np.zeros(len(column), np.int64), np.zeros(len(column))
    for at, to, data, ends in _texts(column):
        text, ends = symbols_of(data, ends)
        count = phrases(model, text, ends)
        cost = count * model.bits[:, None]
        best[at:to] = won = cost.argmin(axis=0)
        if len(model.languages) > 1:
            low = np.partition(cost, 1, axis=0)[:2]
            score[at:to] = 1 - low[0] / np.maximum(low[1], 1)
        row = np.arange(to - at)
        needed[at:to] = count[won, row]
        bits[at:to] = cost[won, row] / np.maximum(np.diff(ends, prepend=0), 1)
    return best, score, needed, bits


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 64, sample_bytes: int = 32 << 10, total_bytes: int = 256 << 10) -> Model:
    """A model of the labelled rows of docs, from whole texts of at most sample_docs rows a language (see above)."""
    text, key = F.col(f"`{text_col}`"), F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))
    rows = docs.filter(F.col(f"`{lang_col}`").isNotNull() & has_letter(text))
    rows = rows.select(F.col(f"`{lang_col}`").alias("lang"), text.alias("text"), key.bitwiseAND((1 << 40) - 1).alias("key"))
    counts = {r[0]: max(1, r[1]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("key")).collect()}  # a row a language
    if not counts:
        return build({})
    budget = min(sample_bytes, total_bytes // len(counts))
    shares = [F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, 4 * sample_docs / n) * (1 << 40)))]
    some = rows.filter(F.col("key") < F.create_map(*shares)[F.col("lang")]).dropDuplicates(["lang", "key"])
    some = some.withColumn("size", F.octet_length("text")).withColumn("fits", F.col("size") <= budget)
    ahead = Window.partitionBy("lang").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    some = some.withColumns({
        "place": F.sum(F.col("fits").cast("int")).over(ahead), "total": F.sum(F.when(F.col("fits"), F.col("size"))).over(ahead),
        "short": F.row_number().over(Window.partitionBy("lang").orderBy("size", "key")),
    })
    chosen = F.col("fits") & (F.col("place") <= sample_docs) & (F.col("total") <= budget) | (F.col("short") == 1) & ~F.col("fits")
    samples: dict[str, list[bytes]] = {}
    for r in sorted(some.filter(chosen).select("lang", "key", "text").collect()):
        raw = r["text"].encode()
        samples.setdefault(r["lang"], []).append(symbols_of(np.frombuffer(raw, np.uint8), np.array([len(raw)]))[0].tobytes())
    return build({lang: b" ".join(texts) for lang, texts in samples.items()})


def _found(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """(row, lang_pred, score, phrases, bits): each row as one struct, and what is found."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.codes, model.symbols, model.table, model.roots, model.bits))  # bounded by the sample parameters

    def predict(batches):
        m = Model(*held.value)
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            letter, n = batch.column(1).to_numpy(zero_copy_only=False), batch.num_rows
            if m.languages:
                best, score, needed, bits = classify(m, batch.column(0).field(at_text))
                name = np.array([*m.languages, "und"], object)[np.where(letter, best, len(m.languages))]
                score, needed, bits = (np.where(letter, x, 0) for x in (score, needed, bits))
            else:
                name, score, needed, bits = np.full(n, "und", object), np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
            columns = pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(needed, pa.int64()), pa.array(bits, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", *FOUND])
        release()

    at_text = docs.columns.index(text_col)
    rows = docs.select(whole_row(docs), has_letter(docs[f"`{text_col}`"]).alias("letter"))
    kinds = (StringType(), DoubleType(), LongType(), DoubleType())
    return rows.mapInArrow(predict, StructType([rows.schema["row"], *[StructField(c, k) for c, k in zip(FOUND, kinds, strict=True)]]))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' columns plus lang_pred, score, phrases and bits (which replace columns of these names): the language,
    its lead over the next one (0 to 1), and how many phrases and bits a symbol the text takes in it."""
    return _found(docs, model, text_col).select(*fields_of_row(docs.columns, FOUND), *FOUND)


def keep_known_languages(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", least_phrases: int = 50, relabel_score: float = 0.25, relabel_phrases: int = 20) -> DataFrame:
    """docs in one of the model's languages, columns as they were but for their label.

    A text goes if it is null or has no letter, or if in its best language it takes more bits than its symbols would
    drawn evenly from the alphabet, over at least ``least_phrases`` phrases: it is in none of the languages. A missing
    label becomes the prediction, and so does one that the prediction contradicts with a score of ``relabel_score`` over
    ``relabel_phrases`` phrases or more. Without any language to compare with, texts with letters stay as they are."""
    found = _found(docs.filter(has_letter(docs[f"`{text_col}`"])), model, text_col)
    foreign = (F.col("phrases") >= least_phrases) & (F.col("bits") > float(np.log2(max(2, model.symbols))))
    old, new = F.col("row").getField(lang_col), F.col("lang_pred")
    sure = (old != new) & (F.col("score") >= relabel_score) & (F.col("phrases") >= relabel_phrases)
    label = F.when(new == "und", old).when(old.isNull() | sure, new).otherwise(old)
    return found.filter(~foreign).select(*fields_of_row(docs.columns, **{lang_col: label}))
