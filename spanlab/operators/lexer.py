"""Corpus tokenisation with offsets and subword flags.

A lossless lexer splits every text into pieces: letter runs of at most 4,
digit runs of at most 3, blank runs of at most 4, and any other single
character.  Non-blank pieces are tokens; a token glued to the previous token
(no blank in between) is a continuation ("subword"), the way a
word-boundary marker is missing on a subword piece.

Texts are lexed in chunks of ``CHUNK`` characters, so a window holds the pieces
of a chunk and never those of a whole document.  A run of letters, digits or blanks that
crosses a border is cut where it would have been cut without the border: a chunk skips the
characters that finish the piece before it and looks ahead 3 characters to finish
its own last one.  Offsets are a two-level prefix sum: inside a chunk, and over the chunks'
totals (``chunk_totals``, one row a chunk).

Any other tokenizer's tokens take the same way: ``tokenize`` runs one over a corpus, ``index_tokens``
numbers a table of offsets chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from ..sources.corpus import DOC_KEY

# Lexer pattern (letters 1-4, digits 1-3, blanks 1-4, other 1).
LEX_RX = r"\p{L}{1,4}|\p{N}{1,3}|[ \t\n\r]{1,4}|[^\p{L}\p{N} \t\n\r]"
BLANK_PIECE_RX = r"^[ \t\n\r]"
_RUN_RX = r"^(?:\p{L}+|\p{N}+|[ \t\n\r]+)"
_ONE_RUN_RX = r"^(?:\p{L}{2}|\p{N}{2}|[ \t\n\r]{2})"
_AHEAD = 3  # a piece has at most 4 characters

#: Characters lexed in one window; a multiple of ``BIN``.
CHUNK = 1 << 16
#: Width of the offset bins of a chunk that spans are looked up in.
BIN = 64

#: Placement of all token tables; sorts compare the column that differs most first.
CHUNK_KEY = ["doc_id", "chunk", "origin"]


def _blank(c):
    return c.isin(" ", "\t", "\n", "\r")


def _check(chunk: int) -> int:
    if chunk < BIN or chunk % BIN:
        raise ValueError(f"a chunk has a multiple of {BIN} characters, not {chunk}")
    return chunk


def chunks(docs: DataFrame, chunk: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """Every text in parts: ``origin, doc_id, chunk, body, skip, before`` and the columns ``keep``.

    ``skip``: characters of the part that finish a piece begun in an earlier one; ``body``: the rest and
    what may finish the last piece; ``before``: the character before ``body`` (null: none).
    """
    size, text, keep = _check(chunk), F.col("source_text"), keep or []
    parts = docs.where(text.isNotNull()).select(*DOC_KEY, *keep, "source_text", F.when(
        F.length(text) <= size, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("_parts"))
    none, n = F.array(F.lit(None).cast("string")), F.size("_parts")
    near = F.arrays_zip(F.col("_parts").alias("part"),
                        F.concat(none, F.slice("_parts", F.lit(1), n - 1)).alias("prev"),
                        F.concat(F.slice("_parts", F.lit(2), n), none).alias("next"))
    # outer: keeps Catalyst from inferring size(..) > 0 and evaluating the arrays twice
    x = parts.select(*DOC_KEY, *keep, "source_text", F.posexplode_outer(near).alias("chunk", "x")).where(
        F.col("chunk").isNotNull()).select(*CHUNK_KEY, *keep, "source_text", "x.*")
    last = F.regexp_extract(F.reverse("prev"), _RUN_RX, 0)
    # a run that fills the whole part before goes on before it
    run = F.when(F.length(last) < size, F.length(last)).otherwise(F.length(F.regexp_extract(
        F.reverse(F.substring("source_text", F.lit(1), F.col("chunk") * size)), _RUN_RX, 0)))
    head = F.regexp_extract(F.substring("part", 1, _AHEAD), _RUN_RX, 0)
    width = F.when(head.rlike(r"^\p{N}"), F.lit(3)).otherwise(F.lit(4))
    joined = F.concat(F.right("prev", F.lit(1)), F.left("part", F.lit(1))).rlike(_ONE_RUN_RX)
    skip = F.when(F.col("prev").isNotNull() & joined, F.least(F.pmod(-run, width), F.length(head))).otherwise(F.lit(0))
    x = x.select(*CHUNK_KEY, *keep, "part", "prev", "next", skip.cast("int").alias("skip"))
    return x.select(
        *CHUNK_KEY, *keep, "skip",
        F.concat(F.substring("part", F.col("skip") + 1, F.lit(size)),
                 F.coalesce(F.left("next", F.lit(_AHEAD)), F.lit(""))).alias("body"),
        F.when(F.col("skip") > 0, F.substring("part", F.col("skip"), F.lit(1)))
        .otherwise(F.right("prev", F.lit(1))).alias("before"))


def lexed(parts: DataFrame, chunk: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """Pieces of ``chunks``: ``origin, doc_id, chunk, pos, piece, pstart, pend, is_tok, upto, is_subword``, where
    ``pos`` and ``upto`` (tokens up to and including this piece) count inside the chunk."""
    keep = keep or []
    # outer: as above, else the lexer's regex would run twice
    x = (parts.select(*CHUNK_KEY, *keep, "skip", "before", F.posexplode_outer(
        F.regexp_extract_all("body", F.lit(LEX_RX), F.lit(0))).alias("pos", "piece"))
         .where(F.col("pos").isNotNull()))
    order = Window.partitionBy(*CHUNK_KEY).orderBy("pos")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # blank pieces are runs of the lexer's blank class: test the first char
    x = x.withColumn("is_tok", ~_blank(F.left("piece", F.lit(1))))
    glued = F.coalesce(F.lag("is_tok").over(order), ~_blank(F.col("before")), F.lit(False))
    end = F.col("chunk") * F.lit(chunk) + F.col("skip") + F.sum(F.length("piece")).over(running)
    x = x.select(*CHUNK_KEY, *keep, "pos", "piece", end.cast("int").alias("pend"), "is_tok",
                 F.sum(F.col("is_tok").cast("int")).over(running).cast("int").alias("upto"), glued.alias("is_subword"))
    x = x.select(*CHUNK_KEY, *keep, "pos", "piece", (F.col("pend") - F.length("piece")).alias("pstart"), "pend", "is_tok", "upto", "is_subword")
    return x.where(F.col("pstart") < (F.col("chunk") + 1) * F.lit(chunk))


def token_lists(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Tokens as one row a chunk: ``origin, doc_id, chunk, n, last_start, last_end, tok, start, end, is_subword, upto, starts, covered``.

    ``tok .. is_subword``: lists of the chunk's ``n`` tokens.  By bins of ``BIN`` characters: ``upto`` (tokens that start in
    earlier bins), ``starts`` and ``covered`` (a bit a character: a token starts there, a token holds it).
    Pieces are found by Spark; their running sums are taken list by list, so that no piece becomes a row and none is sorted.  Chunks
    are placed by their own key, so a long document is spread over tasks; parts with equal keys are lexed as one.
    """
    found = F.regexp_extract_all("body", F.lit(LEX_RX), F.lit(0)).alias("pieces")
    parts = chunks(docs, chunk).repartition(shuffle_partitions(docs.sparkSession), *CHUNK_KEY)
    return _listed(parts, found, docs, chunk, texts=True)


def token_marks(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The places of ``token_lists`` without its lists of tokens: ``origin, doc_id, chunk, n, last_start, last_end, upto, starts, covered,
    glued``, where ``glued`` has a bit a token: it is a subword.

    Less is written than the texts hold.  Spark turns every body into one byte a character (other scripts' letters, numbers and signs
    by the classes of ``LEX_RX``), on which the runs are cut without a string a piece.  Chunks are placed by document, where
    its annotations are found.
    """
    kinds = F.col("body")
    for rx, to in ((r"[\p{L}&&[^\x00-\x7F]]", "a"), (r"[\p{N}&&[^\x00-\x7F]]", "0"), (r"[^\x00-\x7F]", ".")):
        kinds = F.regexp_replace(kinds, rx, to)
    plain = F.octet_length("body") == F.length("body")
    parts = chunks(docs, chunk).repartition(shuffle_partitions(docs.sparkSession), *DOC_KEY)
    return _listed(parts, F.when(plain, F.col("body")).otherwise(kinds).alias("kinds"), docs, chunk, texts=False)


def _binner(size: int) -> Callable:
    """What the makers of lists share (a closure, so that tasks get it by value): the bins of tokens ordered by key and start."""
    width = BIN

    def binned(of, start, end, first):
        """Of every key its tokens' number, its last token and the Arrow lists ``upto, starts, covered, many``.

        ``of``: keys of the tokens, numbered from 0 without gaps; ``first``: where each key's chunk begins.  A token covers its characters up to
        the next token.  ``upto`` counts starts; ``many`` has the tokens up to each start, if some start is that of more than one (else empty).
        """
        import numpy as np
        import pyarrow as pa

        def before(counts):
            return np.cumsum(counts) - counts

        def listed(values, counts):
            at = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=at[1:])
            return pa.ListArray.from_arrays(pa.array(at), values)

        def bits(flags):
            return listed(pa.array(np.packbits(flags, bitorder="little").view("<i8")), bins)
        n = np.bincount(of, minlength=len(first))
        last = np.cumsum(n) - 1
        bins = (np.minimum(end[last] - first, size) - 1) // width + 1
        to = before(bins)
        place = to[of] * width + start - first[of]
        stop = to[of] * width + np.minimum(end - first[of], bins[of] * width)
        stop[:-1] = np.where(of[1:] == of[:-1], np.minimum(stop[:-1], place[1:]), stop[:-1])
        some = stop > place
        starts, edge = np.zeros(bins.sum() * width, bool), np.zeros(bins.sum() * width + 1, np.int8)
        starts[place] = True
        edge[place[some]] += 1
        edge[stop[some]] -= 1
        covered = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)

        head = np.flatnonzero(np.diff(place, prepend=-1))
        upto = before(np.bincount(place[head] // width, minlength=bins.sum()))
        upto = upto - np.repeat(upto[to], bins)
        apart = np.bincount(of[head], minlength=len(first))
        twice = apart < n
        many = (np.append(head[1:], len(of)) - before(n)[of[head]])[twice[of[head]]]
        return n, last, [listed(pa.array(upto.astype(np.int32)), bins), bits(starts), bits(covered),
                         listed(pa.array(many.astype(np.int32)), np.where(twice, apart, 0))]
    return binned


def _listed(parts: DataFrame, found: Column, docs: DataFrame, chunk: int, texts: bool) -> DataFrame:
    """``token_lists`` (``texts``; ``found``: lists of pieces) or ``token_marks`` (``found``: a byte a character) of placed ``chunks``."""
    from pyspark.sql import types as T

    size, keys = _check(chunk), list(CHUNK_KEY)
    binned = _binner(size)
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    lists_of = [("tok", T.ArrayType(T.StringType())), ("start", ints), ("end", ints), ("is_subword", T.ArrayType(T.BooleanType()))]
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("chunk", T.IntegerType()), docs.schema["origin"],
        *[T.StructField(c, T.IntegerType()) for c in ("n", "last_start", "last_end")],
        *[T.StructField(c, t) for c, t in lists_of if texts], T.StructField("upto", ints),
        *[T.StructField(c, longs) for c in ("starts", "covered", *([] if texts else ["glued"]))]])
    names_of = schema.names

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        blank = np.zeros(256, bool)
        blank[[9, 10, 13, 32]] = True
        # widths of pieces by class: other, blank, letter, digit
        kind_of, widest = np.where(blank, 1, 0).astype(np.int8), np.array([1, 4, 4, 3])
        kind_of[[*range(65, 91), *range(97, 123)]], kind_of[48:58] = 2, 3

        def key(b, i):
            return tuple(b.column(k)[i].as_py() for k in keys)

        def few(b):
            """Rows of a batch, some 256 or of a million characters at a time."""
            if texts:
                yield from (b.slice(i, 256) for i in range(0, b.num_rows, 256))
                return
            long = pc.fill_null(pc.binary_length(b.column("kinds")), 0).to_numpy().cumsum() >> 20
            cuts = [0, *(np.flatnonzero(np.diff(long)) + 1), b.num_rows]
            yield from (b.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i)

        def whole():
            """Parts a few at a time, those of equal keys together."""
            held = None
            for b in (x for b in batches for x in few(b)):
                if held is not None:
                    b = pa.concat_batches([held, b])
                k, last = b.num_rows - 1, key(b, b.num_rows - 1)
                while k and last[0] is not None and key(b, k - 1) == last:
                    k -= 1
                held = b.slice(k)
                if k:
                    yield b.slice(0, k)
            if held is not None:
                yield held

        def listed(values, counts):
            at = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=at[1:])
            return pa.ListArray.from_arrays(pa.array(at), values)

        def before(counts):
            return np.cumsum(counts) - counts

        def cut(kinds, rows):
            """Pieces of one byte a character: their numbers by row, rows, lengths and whether they are tokens."""
            at = np.frombuffer(kinds.buffers()[1], np.int32)[kinds.offset:kinds.offset + rows + 1]
            data = kinds.buffers()[2]
            kind = kind_of[np.frombuffer(data, np.uint8)[at[0]:at[-1]]] if at[-1] > at[0] else np.zeros(0, np.int8)
            new = np.ones(len(kind), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
            new[(at[:-1] - at[0])[at[:-1] < at[1:]]] = True
            runs = np.flatnonzero(new)
            long, most = np.diff(runs, append=len(kind)), widest[kind[runs]]
            n = -(-long // most)
            of = np.repeat(np.arange(len(runs)), n)
            done = (np.arange(len(of)) - before(n)[of]) * most[of]
            row = np.searchsorted(at[1:] - at[0], runs, side="right")[of]
            return np.bincount(row, minlength=rows), row, np.minimum(long[of] - done, most[of]), kind[runs][of] != 1

        for b in whole():
            rows = b.num_rows
            doc, number, origin = (b.column(k) for k in keys)
            ids, known, part = pc.fill_null(doc, 0).to_numpy(), pc.is_valid(doc).to_numpy(zero_copy_only=False), number.to_numpy()
            names = np.array(origin.to_pylist(), dtype=object)
            new = np.ones(rows, bool)
            new[1:] = ~known[1:] | ~known[:-1] | (ids[1:] != ids[:-1]) | (part[1:] != part[:-1]) | (names[1:] != names[:-1])
            group, lead = np.cumsum(new) - 1, np.flatnonzero(new)

            if texts:
                pieces = b.column("pieces")
                counts = pc.fill_null(pieces.value_lengths(), 0).to_numpy()
                flat, row = pieces.flatten().cast(pa.string()), np.repeat(np.arange(rows), counts)
            else:
                counts, row, length, is_tok = cut(b.column("kinds").cast(pa.string()), rows)
            if not len(row):
                continue
            if len(lead) < rows:  # pieces of equal keys by their positions
                order = np.lexsort((np.arange(len(row)) - np.repeat(before(counts), counts), group[row]))
                row = row[order]
                if texts:
                    flat = flat.take(pa.array(order))
                else:
                    length, is_tok = length[order], is_tok[order]
            of = group[row]
            if texts:
                at = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:flat.offset + len(flat)]
                is_tok = ~blank[np.frombuffer(flat.buffers()[2], np.uint8)[at]]
                length = pc.utf8_length(flat).to_numpy().astype(np.int64)
            opens = np.flatnonzero(np.diff(of, prepend=-1))
            total = np.cumsum(length)
            inside = total - np.repeat((total - length)[opens], np.diff(opens, append=len(of)))
            first = part[lead].astype(np.int64) * size  # of each key
            end = first[of] + b.column("skip").to_numpy()[row] + inside
            start = end - length
            glued = np.zeros(len(of), bool)
            glued[1:] = is_tok[:-1]
            joined = np.array([c is not None and c not in {" ", "\t", "\n", "\r"} for c in b.column("before").to_pylist()], bool)
            glued[opens] = joined[row[opens]]

            mine = np.flatnonzero(is_tok & (start < first[of] + size))
            n = np.bincount(of[mine], minlength=len(lead))
            some = np.flatnonzero(n)  # keys with tokens
            if not len(some):
                continue
            n, of = n[some], np.repeat(np.arange(len(some)), n[some])
            first, start, end = first[some], start[mine], end[mine]
            n, last, places = binned(of, start, end, first)
            words = -(-n // 64)  # of a bit a token
            subs = np.zeros(words.sum() * 64, bool)
            subs[(before(words) * 64 - before(n))[of] + np.arange(len(of))] = glued[mine]
            lists = [flat.take(pa.array(mine)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
                     pa.array(glued[mine])] if texts else []
            out = b.take(pa.array(lead[some]))
            yield pa.record_batch([
                out.column("doc_id"), out.column("chunk"), out.column("origin"),
                *[pa.array(x.astype(np.int32)) for x in (n, start[last], end[last])], *[listed(x, n) for x in lists],
                *places[:3], *([] if texts else [listed(pa.array(np.packbits(subs, bitorder="little").view("<i8")), words)])], names=names_of)

    return parts.sortWithinPartitions(*CHUNK_KEY).select(*CHUNK_KEY, "skip", "before", found).mapInArrow(run, schema)


def listed_tokens(lists: DataFrame) -> DataFrame:
    """``token_lists`` as rows: ``origin, doc_id, chunk, lidx, tok, start, end, nxt, is_subword`` and its plain columns.

    ``nxt``: start of the next token of the chunk."""
    keep = [c for c in lists.columns if c not in ("n", "last_start", "last_end", "tok", "start", "end", "is_subword", "upto", "starts", "covered", "many")]
    nxt = F.concat(F.slice("start", F.lit(2), F.col("n")), F.array(F.lit(None).cast("int")))
    x = lists.select(*keep, F.posexplode(F.arrays_zip("tok", "start", "end", nxt.alias("nxt"), "is_subword")).alias("at", "x"))
    return x.select(*keep, (F.col("at") + 1).alias("lidx"), "x.*")


def token_chunks(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Tokens with their places in their chunk: ``origin, doc_id, chunk, lidx, tok, start, end, nxt, is_subword``."""
    return listed_tokens(token_lists(docs, chunk)).select(*CHUNK_KEY, "lidx", "tok", "start", "end", "is_subword", "nxt")


def index_tokens(tokens: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Any tokenizer's tokens (``origin, doc_id, start, end`` and more columns) with ``chunk, lidx, nxt``.

    Tokens may have any length and gaps between them but don't overlap; those without characters, as special
    tokens have, are left out.
    """
    x = tokens.where(F.col("end") > F.col("start")).withColumn("chunk", F.floor(F.col("start") / F.lit(_check(chunk))).cast("int"))
    order = Window.partitionBy(*CHUNK_KEY).orderBy("start")
    return x.withColumns({"lidx": F.row_number().over(order), "nxt": F.lead("start").over(order)})


def chunk_totals(tokens: DataFrame) -> DataFrame:
    """One row for every chunk from a document's first with tokens to its last: ``base`` (tokens before it), ``n`` (in it),
    ``last_start`` (of its last token), ``before_end`` and ``before_chunk`` (of the last token before it), ``n_tok``.

    ``tokens``: ``token_lists``, ``token_marks``, ``token_chunks`` or ``index_tokens``.
    """
    if "starts" in tokens.columns:
        g = tokens.groupBy(*CHUNK_KEY).agg(*[F.max(c).alias(c) for c in ("n", "last_end", "last_start")])
    else:
        g = tokens.groupBy(*CHUNK_KEY).agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("end").alias("last_end"),
                                           F.max("start").alias("last_start"))
    order = Window.partitionBy(*DOC_KEY).orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    g = g.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("base"),
                 F.max("last_end").over(before).alias("before_end"), F.lag("chunk").over(order).alias("before_chunk"),
                 F.sum("n").over(Window.partitionBy(*DOC_KEY)).cast("int").alias("n_tok"), F.lead("chunk").over(order).alias("_next"))
    # a chunk without tokens takes over from the one before it
    x = g.withColumn("at", F.explode(F.sequence("chunk", F.coalesce(F.col("_next") - 1, "chunk"))))
    own = F.col("at") == F.col("chunk")

    def pick(mine, later):
        return F.when(own, mine).otherwise(later)
    return x.select(
        *DOC_KEY, F.col("at").alias("chunk"), pick(F.col("base"), F.col("base") + F.col("n")).alias("base"), pick(F.col("n"), F.lit(0)).alias("n"),
        pick(F.col("last_start"), F.lit(None)).alias("last_start"),
        pick(F.col("before_end"), F.greatest("before_end", "last_end")).alias("before_end"),
        pick(F.col("before_chunk"), F.col("chunk")).alias("before_chunk"), "n_tok")


def numbered(tokens: DataFrame, totals: DataFrame) -> DataFrame:
    """Tokens with ``idx`` (1..n in the document) and ``n_tok``."""
    t = totals.select(*CHUNK_KEY, "base", "n_tok").hint("merge")
    return tokens.join(t, CHUNK_KEY).withColumn("idx", F.col("base") + F.col("lidx")).drop("base")


def pieces(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every piece of every text.

    Output: ``origin, doc_id, pos, piece, pstart, pend, is_tok, idx_upto,
    is_subword, n_tok`` where ``idx_upto`` is the number of tokens up to and
    including this piece (the token's 1-based ``idx`` when ``is_tok``).
    """
    x = lexed(chunks(docs, chunk), chunk)
    g = x.groupBy(*CHUNK_KEY).agg(F.count(F.lit(1)).alias("np"), F.max("upto").alias("n"))
    order = Window.partitionBy(*DOC_KEY).orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    g = g.select(*CHUNK_KEY, F.coalesce(F.sum("np").over(before), F.lit(0)).alias("pbase"),
                 F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                 F.sum("n").over(Window.partitionBy(*DOC_KEY)).cast("int").alias("n_tok"))
    return x.join(g.hint("merge"), CHUNK_KEY).select(
        *DOC_KEY, (F.col("pbase") + F.col("pos")).cast("int").alias("pos"), "piece", "pstart", "pend", "is_tok",
        (F.col("base") + F.col("upto")).cast("int").alias("idx_upto"), "is_subword", "n_tok")


def tokens_from_pieces(p: DataFrame) -> DataFrame:
    """``origin, doc_id, idx, tok, start, end, is_subword, n_tok`` (idx 1..n)."""
    return p.where("is_tok").select(
        *DOC_KEY, F.col("idx_upto").alias("idx"), F.col("piece").alias("tok"),
        F.col("pstart").alias("start"), F.col("pend").alias("end"), "is_subword", "n_tok")


def tokens(docs: DataFrame) -> DataFrame:
    return tokens_from_pieces(pieces(docs))


def corpus_counts(docs: DataFrame, by: list[str], chunk: int = CHUNK) -> DataFrame:
    """Documents with tokens and their tokens, ``n_docs`` and ``n_tok``, by columns of ``docs``.  One pass:
    ``by`` travels with the chunks, and a document counts where its first token is."""
    keep = [c for c in by if c not in DOC_KEY]
    spark = docs.sparkSession
    x = lexed(chunks(docs, chunk, keep).repartition(shuffle_partitions(spark), *CHUNK_KEY), chunk, keep).where("is_tok")
    per = x.groupBy(*CHUNK_KEY, *keep).agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy(*DOC_KEY, *keep).agg(F.sum("n").alias("n"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tok"))


#: Texts that a tokenizer gets at once.
TOKENIZER_BATCH = 32

TokenizerFactory = Callable[[], Callable[[list[str]], list[list[tuple[int, int]]]]]


def tokenize(docs: DataFrame, factory: TokenizerFactory) -> DataFrame:
    """A user's tokenizer over a corpus: ``origin, doc_id, idx, tok, start, end, is_subword``.

    ``factory()`` is called once a task and gives a function from a list of texts to lists of
    (start, end) character offsets, as fast tokenizers return them; it gets up to ``TOKENIZER_BATCH`` texts, so that a worker holds
    the tokens of these and not of a whole Arrow batch.  ``idx`` counts the tokens
    with characters from 1; a token that begins where the one before ends is a subword.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*[docs.schema[c] for c in DOC_KEY], T.StructField("idx", T.IntegerType()), T.StructField("tok", T.StringType()),
                           T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                           T.StructField("is_subword", T.BooleanType())])
    arrow, size = to_arrow_schema(schema), TOKENIZER_BATCH

    def run(batches) -> Iterator:
        import pyarrow as pa

        offsets_of = factory()
        for b in (b.slice(i, size) for b in batches for i in range(0, b.num_rows, size)):
            rows = [r for r in zip(*(b.column(i).to_pylist() for i in range(3))) if r[2] is not None]
            cols: list[list] = [[] for _ in arrow.names]
            for (origin, doc_id, text), spans in zip(rows, offsets_of([r[2] for r in rows])):
                last = -1
                for i, (s, e) in enumerate(sorted(x for x in spans if x[1] > x[0]), 1):
                    for c, v in zip(cols, (origin, doc_id, i, text[s:e], s, e, s == last)):
                        c.append(v)
                    last = e
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, arrow.types)], names=arrow.names)

    return docs.select(*DOC_KEY, "source_text").mapInArrow(run, schema)


def tokenize_lists(docs: DataFrame, factory: TokenizerFactory, chunk: int = CHUNK) -> DataFrame:
    """``tokenize`` as one row a chunk: the columns of ``token_lists``, and ``many`` (of chunks where tokens begin at the same character,
    as those of rows that come twice: the tokens up to each start; else empty).

    A token lies in the chunk it begins in.  Documents are placed by their own key, where their annotations are found; tokens of rows
    with equal keys are numbered as one text's, by their starts.
    """
    from pyspark.sql import types as T

    size, few = _check(chunk), TOKENIZER_BATCH
    binned = _binner(size)
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("chunk", T.IntegerType()), docs.schema["origin"],
        *[T.StructField(c, T.IntegerType()) for c in ("n", "last_start", "last_end")], T.StructField("tok", T.ArrayType(T.StringType())),
        T.StructField("start", ints), T.StructField("end", ints), T.StructField("is_subword", T.ArrayType(T.BooleanType())),
        T.StructField("upto", ints), T.StructField("starts", longs), T.StructField("covered", longs), T.StructField("many", ints)])
    names_of = schema.names

    def run(batches: Iterator) -> Iterator:
        from itertools import chain

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        offsets_of = factory()

        def listed(values, counts):
            at = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=at[1:])
            return pa.ListArray.from_arrays(pa.array(at), values)

        def cut(texts, row, start, end):
            """Characters ``start`` to ``end`` of the texts in ``row``, as one Arrow column."""
            data = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
            chars = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))  # where each character begins
            long = pc.utf8_length(texts).to_numpy().astype(np.int64)
            opens = np.cumsum(long) - long
            first, last = (chars[opens[row] + np.minimum(x, long[row])] for x in (start, end))
            size = last - first
            ends = np.cumsum(size)
            taken = data[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            return pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(taken))

        def tokenized(b):
            """One row a text: its key and the lists of its tokens."""
            texts = b.column("source_text").to_pylist()
            found = [list(x) for x in offsets_of(texts)]
            counts = np.array([len(x) for x in found], np.int64)
            at = np.fromiter(chain.from_iterable(chain.from_iterable(found)), np.int64, 2 * counts.sum()).reshape(-1, 2)
            row = np.repeat(np.arange(len(found)), counts)
            own = at[:, 1] > at[:, 0]
            row, start, end = row[own], at[own, 0], at[own, 1]
            follows = np.diff(row) == 0
            if (follows & ((np.diff(start) < 0) | ((np.diff(start) == 0) & (np.diff(end) < 0)))).any():
                order = np.lexsort((end, start, row))
                start, end = start[order], end[order]
            sub = np.zeros(len(row), bool)
            sub[1:] = follows & (start[1:] == end[:-1])
            tok = cut(b.column("source_text"), row, start, end)
            counts = np.bincount(row, minlength=b.num_rows)
            return pa.record_batch([b.column("origin"), b.column("doc_id"), *[listed(x, counts) for x in (
                tok, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(sub))]],
                names=["origin", "doc_id", "tok", "start", "end", "is_subword"])

        def key(b, i):
            return b.column("doc_id")[i].as_py(), b.column("origin")[i].as_py()

        def whole():
            """Texts a few at a time, those of equal keys together."""
            held = None
            for b in (tokenized(b.slice(i, few)) for b in batches for i in range(0, b.num_rows, few)):
                if held is not None:
                    b = pa.concat_batches([held, b])
                k, last = b.num_rows - 1, key(b, b.num_rows - 1)
                while k and last[0] is not None and key(b, k - 1) == last:
                    k -= 1
                held = b.slice(k)
                if k:
                    yield b.slice(0, k)
            if held is not None:
                yield held

        for b in whole():
            tok, start, end, sub = (b.column(c).flatten() for c in ("tok", "start", "end", "is_subword"))
            if not len(tok):
                continue
            row = np.repeat(np.arange(b.num_rows), b.column("tok").value_lengths().to_numpy())
            keys = [key(b, i) for i in range(b.num_rows)]
            copy = np.array([False, *[x == y and x[0] is not None for x, y in zip(keys, keys[1:])]])
            if copy.any():
                lead = np.maximum.accumulate(np.where(copy, 0, np.arange(len(copy))))
                order = np.lexsort((start.to_numpy(), lead[row]))
                row, (tok, start, end, sub) = lead[row][order], (x.take(pa.array(order)) for x in (tok, start, end, sub))
            at, to = (x.to_numpy().astype(np.int64) for x in (start, end))
            part = at // size
            heads = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
            of = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(row)))
            n, last, places = binned(of, at, to, part[heads] * size)
            mine = b.take(pa.array(row[heads]))
            yield pa.record_batch([
                mine.column("doc_id"), pa.array(part[heads].astype(np.int32)), mine.column("origin"),
                *[pa.array(x.astype(np.int32)) for x in (n, at[last], np.maximum.reduceat(to, heads))],
                *[listed(x, n) for x in (tok, start, end, sub)], *places], names=names_of)

    x = docs.where(F.col("source_text").isNotNull()).select(*DOC_KEY, "source_text").repartition(shuffle_partitions(docs.sparkSession), *DOC_KEY)
    return x.sortWithinPartitions(*DOC_KEY).mapInArrow(run, schema)
