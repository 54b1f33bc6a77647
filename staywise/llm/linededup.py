"""Line dedup as an exact set-similarity join of lines, in DataFrame operations only.

A line is the set of its words (runs of characters other than ASCII blanks). The earliest line, by document key and
line number, of all lines with one set of words stands for them. Among these, a line is removed when an earlier one
has a Jaccard similarity of at least ``num / den`` with it. Words are ordered from rare to frequent, so that two
similar lines must share one of their few rarest words (prefix filter); the place of the shared word and the sizes
bound the overlap (positional and length filter); parity maps of the words bound the symmetric difference;
what is left is verified on the words themselves. Rarity comes from counts over all words in 2**RARITY_BITS hash
buckets, whose size does not depend on the data. It orders, and an order may be coarse, so nothing is missed.

Similar lines may come in their thousands, so pairs of a group are not listed: a line first meets the earliest line
for each of its rare words, which settles nearly all; only lines not settled meet all others.

A line without words is kept. A document that loses all its lines keeps an empty text; a null text stays null. A line
is named by document, place and a tag, which is the hash of its set of words where a key stands on rows with different
texts and 0 elsewhere: such rows are decided line by line, and of two sets at the same place the one with the smaller
hash counts as earlier. Rows with a null key stay as they are. Extra columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staywise.llm.common import materialize, missing, packed, tidy

NUM, DEN = 4, 5
RARITY_BITS = 18
#: Parts of the words that are joined one after the other: only one part's shuffle files are on disk at a time.
ROUNDS = 2
#: Columns of the parity map of all lines, and the number of words above which a line has a wide map as well.
PARITY, LONG = ("parity0", "parity1"), 192
#: Bytes of the map that tells which lines are to be verified, as a power of two.
MAP_BITS = 17
_TRIMMED = " \t\n\x0b\f\r"
_LOW = (1 << 56) - 1
#: What names a line: document, place and tag.
NAME = ("doc", "pos", "tag")
OTHER = tuple(f"{c}_2" for c in NAME)


#: xxhash64 of the empty string (fixed value).
_EMPTY = -7444071767201028348


def _word_hashes(line: Column) -> Column:
    """Distinct hashes of a line's words in order; blanks become spaces first, as parting at one character is fast."""
    for blank in "\t\x0b\f\r":
        line = F.replace(line, F.lit(blank), F.lit(" "))
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_remove(F.array_distinct(hashes), F.lit(_EMPTY)))  # between two spaces is no word


def rarity_table(documents: DataFrame, text: str = "text") -> bytes:
    """A level below 16 for each hash bucket: the logarithm of how often its words stand in all documents, 15 at most."""
    size = 1 << RARITY_BITS
    # Words are parted at spaces and line ends here; other blanks are rare, and an order may be coarse.
    words = documents.select(F.explode(F.split(F.replace(F.col(f"`{text}`"), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(F.pmod(F.xxhash64("w"), F.lit(size)).cast("int").alias("b")).count()
    level = F.least(F.lit(15), F.floor(F.log2("count"))).cast("long")
    return _bytes(counts.select("b", level.alias("value")), size)


def _bytes(values: DataFrame, size: int) -> bytes:
    """Rows (b, value) with a value below 128 for some of the numbers below ``size``, as one byte each."""
    eight = values.groupBy(F.floor(F.col("b") / 8).cast("int").alias("at")).agg(
        F.sum(F.expr("shiftleft(value, 7 * (b % 8))")).alias("packed")
    )
    out = bytearray(size + 8)
    with tidy(values.sparkSession):
        for at, packed_values in eight.select("*").collect():  # size / 8 rows at most
            for k in range(8):
                out[8 * at + k] = packed_values >> 7 * k & 127
    return bytes(out[:size])


def _token(h: Column, rarity: bytes) -> Column:
    """Rarity of the word's bucket, then 56 bits of its hash: a word as a long that sorts by rarity."""
    # Sixteen levels to a long, as the table is part of the plan; the text is folded to a constant array.
    pairs = bytes(a | b << 4 for a, b in zip(rarity[::2], rarity[1::2], strict=True))
    longs = [int.from_bytes(pairs[i : i + 8], "little", signed=True) for i in range(0, len(pairs), 8)]
    levels = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")
    # Bucket: the low bits of the hash; all but four of them are the place of the long, four the place in it.
    held = F.get(levels, F.shiftright(h, 4).bitwiseAND(F.lit(len(longs) - 1)).cast("int"))
    level = F.call_function("shiftright", held, F.shiftleft(h, 2).bitwiseAND(F.lit(60)).cast("int")).bitwiseAND(F.lit(15))
    return F.shiftleft(level, 56).bitwiseOR(h.bitwiseAND(F.lit(_LOW)))


def lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (doc, pos, line) for the lines with words of documents that have a key."""
    rows = documents.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{key}`").alias("doc"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("pos", "line")
    )
    return rows.where(~_blank(F.col("line")))


def _blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(_TRIMMED)) == ""  # looks at a line from its start only


def _tokens(hashes: Column, rarity: bytes) -> Column:
    return F.sort_array(F.transform(hashes, lambda h: _token(h, rarity)))


def several_texts(documents: DataFrame, key: str, text: str) -> DataFrame | None:
    """Keys (doc) that stand on rows with different texts; None if there are none, so that nothing is joined then."""
    named = documents.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    found = materialize(named.groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("doc"))
    return None if found.isEmpty() else found


def _tagged(rows: DataFrame, several: DataFrame | None) -> DataFrame:
    """The rows with their tag, from the column s1."""
    if several is None:
        return rows.withColumn("tag", F.lit(0).cast("long"))
    marked = rows.join(several.withColumn("_several", F.lit(True)), "doc", "left")
    return marked.withColumn("tag", F.when(F.col("_several"), F.col("s1")).otherwise(F.lit(0))).drop("_several")


def _toggle(bits: Column, token: Column) -> Column:
    return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), token.bitwiseAND(F.lit(63)).cast("int")))


def _parity(hashes: Column, slots: Column) -> Column:
    """The parity map of sorted hashes, 64 bits to a slot: a word toggles the bit that its hash names.

    A slot is a range of hashes, that is a slice, so each word is looked at once; ``slots`` is a power of two, at least 2.
    """
    bits = F.log2(slots).cast("int")
    start = lambda k: F.call_function("shiftleft", k.cast("long") - F.shiftright(slots, 1), F.lit(64) - bits)
    # How many hashes are below the start of each slot; the first one has none, after the last come all.
    below = lambda k: F.when(k == 0, 0).when(k == slots, F.size(hashes)).otherwise(
        F.array_position(F.sort_array(F.array_append(hashes, start(k))), start(k)).cast("int") - 1
    )
    return F.transform(F.transform(F.sequence(F.lit(0), slots - 1), lambda k: F.struct(below(k).alias("a"), below(k + 1).alias("b"))), lambda r: F.aggregate(
        F.slice(hashes, r["a"] + 1, r["b"] - r["a"]), F.lit(0).cast("long"), _toggle
    ))


def distinct_sets(documents: DataFrame, rarity: bytes, several: DataFrame | None, key: str, text: str, num: int, den: int) -> DataFrame:
    """Rows (NAME..., size, prefix, PARITY..., wide), one for each set of words: its earliest line."""
    # Hashes and tokens are columns of steps of their own, so that each is worked out once and outside of lambdas.
    own = lines(documents, key, text).select("doc", "pos", _word_hashes(F.col("line")).alias("h"))
    own = own.select("doc", "pos", "h", F.size("h").alias("size"), _tokens(F.col("h"), rarity).alias("t"))
    # The sign parts the hashes in two; zero, put among them, tells where.
    own = own.select("*", (F.array_position(F.sort_array(F.array_append("h", F.lit(0).cast("long"))), F.lit(0).cast("long")) - 1).cast("int").alias("minus"))
    size = F.col("size")
    # A line of n words with a similar one shares one of its n - ceil(n * num / den) + 1 rarest words.
    # Here 31 bits of a word do: they only choose which lines meet.
    prefix = F.transform(F.slice("t", F.lit(1), size - F.ceil(size * num / den).cast("int") + 1), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    halves = [F.slice("h", F.lit(1), F.col("minus")), F.slice("h", F.col("minus") + 1, size - F.col("minus"))]
    maps = [F.aggregate(half, F.lit(0).cast("long"), _toggle).alias(p) for half, p in zip(halves, PARITY, strict=True)]
    # One more map with as many bits as a long line has words: the one of all lines is full then.
    slots = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(size / 64.0)).cast("int")))
    wide = F.when(size > LONG * num / den, _parity(F.col("h"), slots))
    described = own.select(
        F.xxhash64("t").alias("s1"), F.xxhash64(F.lit(7), "t").alias("s2"), "doc", "pos",
        F.struct("size", prefix.alias("prefix"), *maps, wide.alias("wide")).alias("what"),
    )
    described, first = _tagged(described, several), F.struct(*NAME)
    return described.groupBy("s1", "s2").agg(F.min(first).alias("first"), F.min_by("what", first).alias("what")).select(
        "first.*", "what.*"
    )


def _similar_enough(x: str, y: str, num: int, den: int) -> Column:
    """Length, positional and parity filters; each holds for every pair that is similar enough."""
    c = lambda side, name: F.col(f"{side}.{name}")
    total = c(x, "size") + c(y, "size")
    rest = F.least(c(x, "size") - c(x, "at"), c(y, "size") - c(y, "at"))  # the shared word included
    apart = _apart(x, y)
    return (
        (c(x, "size") * den >= c(y, "size") * num)
        & (c(y, "size") * den >= c(x, "size") * num)
        & (rest * (num + den) >= total * num)
        & (apart * (num + den) <= total * (den - num))
    )


def _apart(x: str, y: str) -> Column:
    return sum(F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITY)


def _wide_apart(a: Column, b: Column) -> Column:
    """Bits in which two wide maps differ; the longer one, which has twice the slots or more, is folded: neighbours are one."""
    n = F.least(F.size(a), F.size(b))

    def folded(m: Column) -> Column:
        each = (F.size(m) / n).cast("int")
        return F.when(F.size(m) == n, m).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(
            F.slice(m, k * each + 1, each), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)
        )))

    return F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _within(keys: DataFrame, *names: str) -> Column:
    """Is a row perhaps among the keys? From two bits for each key in one of 2**MAP_BITS bytes; never wrongly no."""
    h = F.xxhash64(*names)
    place = F.pmod(h, F.lit(1 << MAP_BITS)).cast("int")
    # Seven bits a byte: such a byte is a character of ASCII.
    bit = lambda shift: F.call_function("shiftleft", F.lit(1), F.pmod(F.shiftright(h, shift), F.lit(7)).cast("int"))
    mask = bit(24).bitwiseOR(bit(40))
    octets = keys.groupBy(place.alias("b")).agg(F.bit_or(mask).cast("long").alias("value"))
    table = F.lit(bytearray(_bytes(octets, 1 << MAP_BITS)))
    return F.ascii(F.substring(table, place + 1, F.lit(1)).cast("string")).bitwiseAND(mask) == mask


def _pairs(met: DataFrame, x: str, y: str) -> DataFrame:
    return met.select(*[F.col(f"{x}.{c}") for c in NAME], *[F.col(f"{y}.{c}").alias(o) for c, o in zip(NAME, OTHER, strict=True)])


def _verified(
    documents: DataFrame, pairs: DataFrame, rarity: bytes, several: DataFrame | None, key: str, text: str, num: int, den: int
) -> DataFrame:
    """NAME of the later lines of the pairs (NAME..., OTHER...) whose word sets are similar enough.

    Reads the words from the documents again; lines that are not in question leave before the shuffle.
    """
    second = [F.col(o).alias(c) for c, o in zip(NAME, OTHER, strict=True)]
    involved = pairs.select(*NAME).unionByName(pairs.select(*second))
    asked = lines(documents, key, text).where(_within(involved, "doc", "pos"))
    words = asked.select("doc", "pos", _word_hashes(F.col("line")).alias("t"))
    tag = F.lit(0) if several is None else F.xxhash64(_tokens(F.col("t"), rarity))
    words = _tagged(words.withColumn("s1", tag), several)
    words = materialize(words.groupBy(*NAME).agg(F.min("t").alias("t")))
    left = pairs.join(words.withColumnRenamed("t", "t1"), list(NAME))
    right = words.select(*[F.col(c).alias(o) for c, o in zip(NAME, OTHER, strict=True)], F.col("t").alias("t2"))
    both = F.size(F.array_intersect("t1", "t2"))
    return (
        left.join(right, list(OTHER))
        .where(both * (num + den) >= (F.size("t1") + F.size("t2")) * num)
        .select(*NAME).distinct()
    )


def removed_sets(
    documents: DataFrame, sets: DataFrame, rarity: bytes, several: DataFrame | None, key: str, text: str, num: int, den: int
) -> DataFrame:
    """NAME of the earliest lines of their sets that are similar to an earlier line."""

    def postings(rows: DataFrame, *more: str) -> DataFrame:
        named = rows.select(*NAME, "size", *PARITY, *more, F.posexplode("prefix").alias("at", "word"))
        return named.select("word", F.struct(*NAME, "size", *PARITY, "at", *more).alias("x"))

    name = lambda side: F.struct(*[f"{side}.{c}" for c in NAME])
    # Names last: they are compared as structs, which are made for each pair of rows that gets there.
    near = _similar_enough("x", "y", num, den) & (name("y") < name("x"))
    apart = _apart("x", "y")
    # The earliest line of each word; of those that may be similar to a line, the one that seems nearest is tried.
    led = postings(sets).withColumn("y", F.min("x").over(Window.partitionBy("word")))
    nearest = led.where(near).groupBy(name("x").alias("x")).agg(F.min(F.struct(apart.alias("apart"), name("y").alias("y"))).alias("b"))
    first = materialize(_pairs(nearest.select("x", F.col("b.y").alias("y")), "x", "y"))
    settled = materialize(_verified(documents, first, rarity, several, key, text, num, den))
    # Lines that are not settled meet all earlier lines of their words, one part of the words after the other.
    perhaps = _within(settled, *NAME)
    open_sets = sets.where(~perhaps).unionByName(sets.where(perhaps).join(settled, list(NAME), "left_anti").select(*sets.columns))

    def meet(xs: DataFrame, ys: DataFrame, close: Column) -> DataFrame:
        met = xs.join(ys.select(F.col("word").alias("word2"), F.col("x").alias("y")), (F.col("word") == F.col("word2")) & close)
        return materialize(_pairs(met, "x", "y").distinct())

    # Long lines meet by themselves: comparing wide maps would take the join of all others out of generated code.
    total = F.col("x.size") + F.col("y.size")
    wide = _wide_apart(F.col("x.wide"), F.col("y.wide")) * (num + den) <= total * (den - num)
    long_enough = F.col("size") > LONG * num / den
    rest = meet(postings(open_sets.where(F.col("size") > LONG), "wide"), postings(sets.where(long_enough), "wide"), near & wide)
    for part in range(ROUNDS):
        mine = F.pmod(F.col("word"), F.lit(ROUNDS)) == part
        short = postings(open_sets.where(F.col("size") <= LONG)).where(mine)
        rest = rest.unionByName(meet(short, postings(sets).where(mine), near))
    rest = rest.distinct()
    return settled.unionByName(materialize(_verified(documents, rest, rarity, several, key, text, num, den)))


def dedup_lines(
    documents: DataFrame, num: int = NUM, den: int = DEN, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents without removed lines, with columns n_lines and n_kept added or replaced."""
    missing(documents, key, text)
    rarity = rarity_table(documents, text)
    several = several_texts(documents, key, text)
    sets = materialize(distinct_sets(documents, rarity, several, key, text, num, den))
    gone = removed_sets(documents, sets, rarity, several, key, text, num, den)
    stay = sets.select(*NAME).join(gone, list(NAME), "left_anti")
    if several is None:
        return _without(documents, stay, key, text, None)
    rows = packed(documents)
    unclear = rows.join(several, F.col("_row")[key] == F.col("doc"), "left_semi").select("_row.*")
    clear = rows.join(several, F.col("_row")[key] == F.col("doc"), "left_anti").select("_row.*")
    return _without(clear, stay, key, text, None).unionByName(_without(unclear, stay, key, text, rarity))


def _without(documents: DataFrame, stay: DataFrame, key: str, text: str, rarity: bytes | None) -> DataFrame:
    """The documents with only the lines that stay: by their places, or with a rarity table by place and set."""
    what = F.col("pos") if rarity is None else F.struct("pos", "tag")
    kept = stay.groupBy("doc").agg(F.collect_list(what).alias("_kept")).withColumnRenamed("doc", "_doc")
    row = F.col("_row")
    joined = packed(documents).join(kept, row[key] == F.col("_doc"), "left")
    joined = joined.select("_row", "_kept", row[text].alias("_text"), F.split(row[text], "\n").alias("_lines"))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    blank = F.filter(every, lambda i: _blank(F.get("_lines", i)))
    if rarity is None:
        inside = F.filter(F.coalesce("_kept", F.array().cast("array<int>")), lambda i: i < F.size("_lines"))
    else:
        tokens = F.transform("_lines", lambda x, i: F.struct(i.alias("pos"), _tokens(_word_hashes(x), rarity).alias("t")))
        names = F.transform(tokens, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["t"]).alias("tag")))
        inside = F.transform(F.filter(names, lambda x: F.coalesce(F.array_contains("_kept", x), F.lit(False))), lambda x: x["pos"])
    own = F.when(row[key].isNull(), every).otherwise(F.array_sort(F.array_union(blank, inside)))
    chosen = joined.withColumn("_own", F.when(F.col("_text").isNotNull(), own))
    cleaned = F.array_join(F.transform("_own", lambda i: F.get("_lines", i)), "\n")
    count = lambda c: F.when(F.col("_own").isNull(), 0).otherwise(F.size(c)).cast("long")
    return chosen.select(
        *[(cleaned if c == text else row[c]).alias(c) for c in documents.columns if c not in ("n_lines", "n_kept")],
        count("_lines").alias("n_lines"), count("_own").alias("n_kept"),
    )


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and text_sha256 (of the text that is left) of every document."""
    return dedup_lines(documents).select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))


#: The same in DuckDB: exact word counts order the words, everything else follows the definition.
ORACLE = r"""
with docs as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
lines as (select doc_id, unnest(range(len(ls))) as pos, unnest(ls) as line from docs where doc_id is not null and text is not null),
trimmed as (select doc_id, pos, trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) as line from lines),
worded as (select doc_id, pos, list_sort(list_distinct(regexp_split_to_array(line, '[\x20\x09-\x0D]+'))) as ws from trimmed where line <> ''),
sets as (select ws, min(row(doc_id, pos)) as f from worded group by ws),
own as (select row_number() over (order by f) as id, ws, len(ws) as n, f from sets),
words as (select id, n, unnest(ws) as w from own),
freq as (select w, count(*) as df from words group by w),
ranked as (select id, n, w, row_number() over (partition by id order by df, w) as r from words join freq using (w)),
prefix as (select id, n, w from ranked where r <= n - (4 * n + 4) // 5 + 1),
cand as (select distinct x.id as a, y.id as b from prefix x join prefix y on x.w = y.w and y.id < x.id and 5 * x.n >= 4 * y.n and 5 * y.n >= 4 * x.n),
gone as (select distinct a from cand join own x on x.id = a join own y on y.id = b
  where 9 * len(list_intersect(x.ws, y.ws)) >= 4 * (x.n + y.n)),
firsts as (select f from own where id not in (select a from gone)),
flags as (select l.doc_id, l.pos, l.line,
    (t.line = '' or row(l.doc_id, l.pos) in (select f from firsts)) as keep
  from lines l join trimmed t on l.doc_id = t.doc_id and l.pos = t.pos),
kept as (select doc_id, count(*) as n_lines, count(*) filter (keep) as n_kept,
    coalesce(string_agg(line, chr(10) order by pos) filter (keep), '') as txt from flags group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_kept, 0)::bigint as n_kept,
  case when d.text is null then null else sha256(coalesce(txt, d.text)) end as text_sha256
from docs d left join kept k on d.doc_id = k.doc_id
"""
