"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Lines are compared lower-cased and trimmed. Equal lines are one line; two lines are near if their edit distance is at
most what the shorter one's length allows: 1 from 16 characters on, 2 from 40, 3 from 64, 4 from 80, 5 from 112, or
`edits` at every length. Near lines are joined to classes (connected components), and of each class only the first line
(smallest doc_id, then line number) stays.

Lines fall into classes of length. As many characters as the shortest of its class has are split into edits + 1
segments: the first half of them counted from the line's start, the others from its end. Of two near lines some segment
i of one is whole in the other, with at most i edits before it and edits - i after it, so it is moved by at most that
many characters, seen from the end it is counted from. Of each segment, windows at a few offsets are hashed, so that any such shift is the
difference of two offsets: lines meet where hashes are equal. A line just longer than its class's least length
is hashed for the class below too. Counts of frequent letters, which an edit changes by two at most, thin out candidates;
in buckets of more than CROWD lines those before and after some places of the line do so too.
Candidates are verified by banded bit-parallel edit distance, after the built-in bounded one.

A bucket of up to SMALL lines gives all its pairs. In a larger one each line is paired with one centre; the bucket's
lines that are then still in several components are split further by what the bucket's segment leaves before or after
it, whichever has more different values: a known number of edits is left there, so it is split into segments of its own,
and so on. Pairs inside a component are not made, nor pairs that share the first segment of a split and so meet in its bucket.
So a group of n near lines costs about n pairs, and n lines that only share a part cost some rows for each level.

Lines shorter than `least` characters are near no other line. Equal lines of `shortest` characters or more are repeats
(by default `least`; queries and pipeline use 1, so that only empty lines are left alone). Defined results: an empty
table gives no rows; a null text has one empty line; very long lines are compared whole; rows of one doc_id are one
document, and equal lines at equal places of it don't replace each other; a null doc_id comes after all others; ties go
to the smaller line number; extra columns pass through, whatever their names, but for names that begin with two
underscores. Lines are told apart by 64-bit hashes, but near lines are verified on their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.components import connected_components
from ._common import DOC_ID, TEXT, written

LEAST = 16
#: A line may have one edit for each STEP characters of its class, from 1 to MOST_EDITS of them.
STEP, MOST_EDITS = 20, 5
#: Offsets at which windows are hashed: every shift up to the index is a difference of two of them.
RULERS = ((0,), (0, 1), (0, 1, 2))
LETTERS = "etnairso", "uhdlcmgp", "bfvwy01.", "23456789"
#: Codes of counts modulo 16: as many bits differ as the counts do, the short way round.
CODES = [(1 << i) - 1 if i <= 8 else 255 << (i - 8) & 255 for i in range(16)]
#: Equal characters kept at either end of lines that are compared: as many as the band is wide on one side, at least.
KEPT = 8
#: Buckets of up to so many lines give all their pairs.
SMALL = 2048
#: Lines of buckets of more than so many have their letters counted before and after CUTS places too.
CROWD, CUTS = 16, 7
#: Bits of the broadcast filter that finds candidates' texts; a bound on its rows, 64 bits each.
BITS = 1 << 24
_LAST_DOC = (1 << 63) - 1


def normalised(line: Column) -> Column:
    """Lower case, without blanks, tabs and carriage returns at either end."""
    ends = F.lit(False)
    for c in " \t\r":
        ends = ends | line.startswith(c) | line.endswith(c)
    # trimming by a set of characters looks at the whole line, so it is done only where needed
    return F.lower(F.when(ends, F.trim(line, F.lit(" \t\r"))).otherwise(line))


def lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, at, line): normalised lines of at least `least` characters."""
    doc = F.coalesce(F.col(DOC_ID).cast("long"), F.lit(_LAST_DOC))
    # normalised within the array: after it, the filter on the length would work every line out a second time
    own = F.transform(F.split(F.coalesce(TEXT, F.lit("")), "\n"), normalised)
    return docs.select(doc.alias("doc"), F.posexplode_outer(own).alias("at", "line")).where(F.length("line") >= least)


def length_class(length: Column) -> Column:
    """The least length of a line's class: the length with all but its first three binary digits made 0."""
    low = F.greatest(F.length(F.bin(length.cast("long"))) - 3, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", length, low), low)


def allowed(floor: Column, edits: int | None) -> Column:
    """Edits that a line whose class begins at `floor` may be apart from a line as long or longer; None: by length."""
    return F.lit(edits) if edits else F.least(F.greatest(F.floor(floor / STEP).cast("int"), F.lit(1)), F.lit(MOST_EDITS))


def _letters(line: Column, letters: str) -> Column:
    """Codes of the counts of eight letters; an edit changes two bits at most."""
    out, codes = F.lit(0).cast("long"), F.array(*map(F.lit, CODES))
    for i, c in enumerate(letters):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))  # c is one byte
        out = out.bitwiseOR(F.shiftleft(F.get(codes, n.bitwiseAND(F.lit(15))).cast("long"), 8 * i))
    return out


def _cuts(line: Column, floor: Column) -> Column:
    """Codes of the letters before and after each of CUTS places of a line whose class begins at `floor`, a struct each.

    Edits before a place change at most twice as many letters of the first characters, and edits after it of the last
    ones: what a part gains or loses by a shift is one letter for an edit that changed only one. So the two sum up to
    twice the edits, without what cancels out over the whole line.
    """

    def codes(k: Column) -> Column:
        h = F.floor(floor * k / (CUTS + 1)).cast("int")
        ends = F.substring(line, F.lit(1), h), F.substring(line, F.length(line) - (floor - h) + 1, floor - h)
        # transforms of one-element arrays name the parts, so that they are not cut out anew for each letter
        return F.get(F.transform(F.array(F.struct(*(e.alias(n) for e, n in zip(ends, "pq")))), lambda s: F.struct(*(_letters(s[n], x).alias(f"{n}{i}") for n in "pq" for i, x in enumerate(LETTERS)))), F.lit(0))

    return F.transform(F.array(*map(F.lit, sorted(range(1, CUTS + 1), key=lambda k: abs(2 * k - CUTS - 1)))), codes)


def banded_distance(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of two character arrays whose sizes differ by `edits` at most, or more than `edits` if it is larger.

    Bit k of a band word stands for character i - edits + k of x beside character i of y; vertical differences of the
    band are kept in two words and a step is a few bit operations, whatever the band's width. Once the band's lower
    edge is out of reach, the other steps do nothing. x and y must be plain columns: an expression would be worked out
    anew in each step.
    """
    w = 2 * edits + 1
    mask = (1 << w) - 1
    diagonal = F.size(x) - edits
    limit = 2 * edits + F.size(y) - F.size(x)

    def lit(v: int) -> Column:
        return F.lit(v).cast("long")

    def step(s: Column, t: Column) -> Column:
        i = s["i"]
        equal = lit(0)
        for k in range(w):
            j = i - edits + k
            equal = equal + F.when((j >= 0) & (F.get(x, j) == t), lit(1 << k)).otherwise(lit(0))
        return F.struct(i.alias("i"), equal.alias("equal"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"))

    def move(s: Column) -> Column:
        vp, vn, e = s["vp"], s["vn"], s["equal"]
        d0 = ((e.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(lit(mask))
        return F.struct(s["i"].alias("i"), d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), s["d"].alias("d"))

    def close(s: Column) -> Column:
        i, d0, vp, vn, d = s["i"], s["d0"], s["vp"], s["vn"], s["d"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(lit(mask))
        hn = d0.bitwiseAND(vp)
        down = d0.bitwiseAND(lit(1 << (w - 1))) == 0
        bit = F.greatest(lit(0), lit(w - 2) - (i - F.greatest(F.lit(0), diagonal)))
        along = F.get(F.array(*(hp.bitwiseAND(lit(1 << k)) != 0 for k in range(w))), bit.cast("int")).cast("int") - F.get(F.array(*(hn.bitwiseAND(lit(1 << k)) != 0 for k in range(w))), bit.cast("int")).cast("int")
        half = F.shiftright(d0, 1)
        return F.struct(
            (i + 1).alias("i"),
            hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(lit(mask))).alias("vp"),
            half.bitwiseAND(hp).alias("vn"),
            (d + F.when(i < diagonal, F.when(down, 1).otherwise(0)).otherwise(along)).alias("d"),
        )

    start = F.struct(F.lit(0).alias("i"), lit(mask & ~((1 << edits) - 1)).alias("vp"), lit(0).alias("vn"), F.lit(edits).alias("d"))

    def run(s: Column, t: Column) -> Column:
        # nested transforms of one-element arrays name each step's results, so nothing is worked out twice
        first = F.transform(F.array(step(s, t)), move)
        return F.when(s["d"] > limit, s).otherwise(F.get(F.transform(first, close), F.lit(0)))

    return F.aggregate(y, start, run, lambda s: s["d"])


def windows(edits: int) -> list[tuple[int, int, int, int]]:
    """(segment, 1 if counted from the end, offset, what the window is shorter than its segment) for a number of edits."""
    out = []
    for i in range(edits + 1):
        ruler = RULERS[min(i, edits - i)]
        out += [(i, int(i > edits - i), offset, ruler[-1]) for offset in ruler]
    return out


def keyed(rows: DataFrame, most: int) -> DataFrame:
    """rows with (key, seg, far, start, width, head) for each window; two near lines share a key. head is the first segment's key.

    rows has (line, chain, a, b, nominal, edits): the characters from a to b of a line, `nominal` of them at least in
    each line of the chain, in which near lines are at most `edits` apart.
    """
    spec = F.lit(None)
    for e in range(1, most + 1):
        spec = F.when(F.col("edits") == e, F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(w, ("seg", "far", "off", "cut")))) for w in windows(e)))).otherwise(spec)
    out = rows.select("*", F.inline(spec))
    size = F.floor(F.col("nominal") / (F.col("edits") + 1)).cast("int")
    width = size - F.col("cut")
    start = F.when(F.col("far") == 0, F.col("a") + F.col("seg") * size + F.col("off")).otherwise(F.col("b") - (F.col("edits") - F.col("seg")) * size - F.col("off") - width)
    out = out.select("*", start.alias("start"), width.alias("width"))
    head = F.xxhash64("chain", F.lit(0), F.substring("line", F.col("a") + 1, size))
    return out.select("*", F.xxhash64("chain", "seg", F.substring("line", F.col("start") + 1, F.col("width"))).alias("key"), head.alias("head"))


def rest(rows: DataFrame) -> DataFrame:
    """Rows of keyed() with what is before or after the window as new (chain, a, b, nominal, edits), the same side for all of a key.

    A side that can't be split any more is taken only if the other can't be either; such rows have nominal 0.
    """
    size = F.floor(F.col("nominal") / (F.col("edits") + 1)).cast("int")
    seg, far = F.col("seg"), F.col("far") == 1
    left = F.when(far, F.col("nominal") - (F.col("edits") - seg + 1) * size).otherwise(seg * size)
    right = F.when(far, (F.col("edits") - seg) * size).otherwise(F.col("nominal") - (seg + 1) * size)

    def side(a: Column, b: Column, nominal: Column, edits: Column) -> Column:
        fits = F.floor(nominal / (edits + 1)) > F.floor(edits / 2)
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.when(fits & (edits > 0), nominal).otherwise(0).cast("int").alias("nominal"), edits.cast("int").alias("edits"))

    after = F.col("start") + F.col("width")
    both = rows.select("id", "component", F.col("key").alias("chain"), "line", side(F.col("a"), F.col("start"), left, seg).alias("l"), side(after, F.col("b"), right, F.col("edits") - seg).alias("r"))
    kinds = both.groupBy("chain").agg(*(F.approx_count_distinct(F.xxhash64(F.substring("line", F.col(f"{x}.a") + 1, F.col(f"{x}.b") - F.col(f"{x}.a")))).alias(f"kinds_{x}") for x in "lr"))
    both = both.drop("line").join(kinds, "chain")
    on = F.when(F.col("l.nominal") == 0, F.lit(True)).when(F.col("r.nominal") == 0, F.lit(False)).otherwise(F.col("kinds_r") >= F.col("kinds_l"))
    return both.select("id", "component", "chain", F.inline(F.array(F.when(on, F.col("r")).otherwise(F.col("l")))))


def _first_rows(own: DataFrame, edits: int | None, least: int) -> DataFrame:
    """(id, line, chain, a, b, nominal, edits) of lines (id, line), for each class that a line is looked up in."""
    n = F.length("line")
    own = own.where(n >= least).select("id", "line", n.alias("b"), length_class(n).cast("int").alias("floor"))
    below = length_class(F.col("floor") - 1).cast("int")
    reaches = (F.col("floor") > least) & (F.col("b") - F.col("floor") < allowed(below, edits))
    seen = own.select("id", "line", "b", F.explode(F.when(reaches, F.array("floor", below)).otherwise(F.array("floor"))).alias("nominal"))
    return seen.select("id", "line", F.col("nominal").cast("long").alias("chain"), F.lit(0).alias("a"), "b", "nominal", allowed(F.col("nominal"), edits).alias("edits"))


def _texts(own: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line, n, about) of the ids and of some others: a filter of fixed size, so that no text is shuffled."""
    slot = F.pmod("id", F.lit(BITS))
    word, bit = F.floor(slot / 64).cast("int"), (slot % 64).cast("int")
    known = ids.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    found = own.select("id", "line", word.alias("own_word"), bit.alias("bit")).join(F.broadcast(known), F.col("own_word") == F.col("word"))
    found = found.where(F.call_function("shiftrightunsigned", F.col("bits"), F.col("bit")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return written(found.select("id", "line", F.length("line").alias("n"), *(_letters(F.col("line"), x).alias(f"about{i}") for i, x in enumerate(LETTERS))), "line-texts")


def _candidates(shared: DataFrame, texts: DataFrame, edits: int | None) -> DataFrame:
    """(a, b) of rows (key, id, centre, size, component, seg, head): pairs of different components, and of different heads
    but for those of segment 0, that letters and lengths allow. A pair is made in one of the buckets of segment 0 that it
    shares, that of the least key."""
    letters = [f"about{i}" for i in range(len(LETTERS))]
    floor = length_class(F.col("n")).cast("int")
    about = texts.select("id", "n", floor.alias("floor"), allowed(floor, edits).alias("most"), *letters)
    cuts = texts.join(shared.where((F.col("size") > CROWD) & (F.col("size") <= SMALL)).select("id").distinct(), "id", "left_semi").select("id", _cuts(F.col("line"), floor).alias("cuts"))
    places = shared.groupBy("id").agg(F.collect_set(F.struct("key", "centre", "size", "component", "seg", "head")).alias("places")).join(about, "id")
    few = places.select("*", F.filter("places", lambda p: p["size"] <= SMALL).alias("few")).where(F.size("few") > 0).join(cuts, "id", "left")
    few = few.select("*", F.transform(F.filter("few", lambda p: p["seg"] == 0), lambda p: p["key"]).alias("keys"), F.inline("few"))
    few = few.withColumn("lower", F.filter("keys", lambda k: k < F.col("key")))
    x, y = (few.select("key", *(F.col(c).alias(c + i) for c in ("id", "component", "n", "most", "seg", "head", "lower", "floor", "cuts", *letters))) for i in "xy")
    limit = F.least("mostx", "mosty")
    close, apart = F.abs(F.col("nx") - F.col("ny")) <= limit, F.lit(0)
    for c in letters:
        apart = apart + F.bit_count(F.col(c + "x").bitwiseXOR(F.col(c + "y")))
        close = close & (apart <= 2 * limit)
    ends = F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")
    codes = [f"{n}{i}" for n in "pq" for i in range(len(LETTERS))]
    fits = F.forall(F.arrays_zip("cutsx", "cutsy"), lambda z: sum((F.bit_count(z["cutsx"][c].bitwiseXOR(z["cutsy"][c])) for c in codes), F.lit(0)) <= 2 * limit)
    fits = F.col("cutsx").isNull() | F.col("cutsy").isNull() | (F.col("floorx") != F.col("floory")) | fits
    # segy is segx: named, so that both sides have the same columns and are dealt once
    pairs = x.join(y, "key").where("idx < idy and componentx <> componenty and (segx = 0 and segy = 0 or headx <> heady)").where(close & ~F.arrays_overlap("lowerx", "lowery") & fits).select(*ends)
    many = places.select("*", F.inline(F.filter("places", lambda p: (p["size"] > SMALL) & (p["centre"] != F.col("id")))))
    many = many.select(*(F.col(c).alias(c + "x") for c in ("id", "n", "most", *letters)), F.col("centre").alias("idy")).distinct()
    star = many.join(about.select(*(F.col(c).alias(c + "y") for c in ("id", "n", "most", *letters))), "idy").where(close).select(*ends)
    return pairs.union(star).distinct()


def _differing(near: DataFrame) -> DataFrame:
    """Rows with character arrays x and y, without what both begin or end with but for KEPT characters at either end."""
    for _ in range(2):  # each turn drops what both begin with and turns both round
        first = F.array_position(F.zip_with("x", "y", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
        first = F.greatest(F.lit(1), F.when(first == 0, F.size("x") + 1).otherwise(first) - KEPT)
        near = near.select("a", "b", "limit", "x", "y", first.cast("int").alias("first"))
        near = near.select("a", "b", "limit", *(F.reverse(F.slice(c, F.col("first"), F.greatest(F.lit(0), F.size(c) - F.col("first") + 1))).alias(c) for c in "xy"))
    return near


def _bounded_distance(x: Column, y: Column, most: int) -> Column:
    """The built-in distance, 255 if it is more than `most`, of what x and y don't both begin or end with.

    Equal ends are found by halving steps. Transforms of one-element arrays name each step's result.
    """
    room, steps = F.least(F.length(x), F.length(y)), F.array(*(F.lit(1 << i) for i in reversed(range(13))))
    begin = F.aggregate(steps, F.lit(0), lambda p, k: F.when((p + k <= room) & (F.substring(x, p + 1, k) == F.substring(y, p + 1, k)), p + k).otherwise(p))

    def end(p: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda q, k: F.when((p + q + k <= room) & (F.substring(x, F.length(x) - q - k + 1, k) == F.substring(y, F.length(y) - q - k + 1, k)), q + k).otherwise(q))

    ends = F.transform(F.transform(F.array(begin), lambda p: F.struct(p.alias("p"), end(p).alias("q"))), lambda s: F.struct(F.greatest(s["p"] - KEPT, F.lit(0)).alias("p"), F.greatest(s["q"] - KEPT, F.lit(0)).alias("q")))
    # -1 stands for more than `most`; as a byte it is 255, so that one comparison works the distance out once
    found = F.transform(ends, lambda s: F.levenshtein(F.substring(x, s["p"] + 1, F.length(x) - s["p"] - s["q"]), F.substring(y, s["p"] + 1, F.length(y) - s["p"] - s["q"]), most).bitwiseAND(F.lit(255)))
    return F.get(found, F.lit(0))


def _verified(pairs: DataFrame, texts: DataFrame, edits: int | None) -> DataFrame:
    most = edits or MOST_EDITS
    x, y = (texts.select(F.col("id").alias(i), F.col("line").alias(n)) for i, n in (("a", "x"), ("b", "y")))
    limit = allowed(length_class(F.least(F.length("x"), F.length("y"))), edits)
    apart = _bounded_distance(F.col("x"), F.col("y"), most)
    near = pairs.join(x, "a").join(y, "b").where(apart <= limit).select("a", "b", limit.alias("limit"), F.split("x", "").alias("x"), F.split("y", "").alias("y"))
    # written, since a filter over columns that are still to be worked out would work them out in each step
    near = written(_differing(near), "line-near")
    return near.where(banded_distance(F.col("x"), F.col("y"), most) <= F.col("limit")).select("a", "b")


def near_pairs(own: DataFrame, edits: int | None, least: int) -> DataFrame:
    """(a, b): near lines of own, which has different lines (id, line); enough of them to link all that are near."""
    most = edits or MOST_EDITS
    if edits is not None and (edits // 2 >= len(RULERS) or least // (edits + 1) <= RULERS[edits // 2][-1] or 1 << (least.bit_length() - 3) < edits):
        raise ValueError(f"{edits} edits need a greater length than {least}")
    same = W.partitionBy("key")

    def bucketed(rows: DataFrame) -> DataFrame:
        """Rows of the keys that several components and, but for segment 0, heads share, with the key's centre and size."""
        for c in ("component", "head"):
            rows = rows.select("*", F.min(c).over(same).alias("lo_" + c), F.max(c).over(same).alias("hi_" + c))
        rows = rows.select("*", F.min("id").over(same).alias("centre"), F.count("*").over(same).alias("size"))
        return rows.where("lo_component < hi_component and (seg = 0 or lo_head < hi_head)").drop("lo_component", "hi_component", "lo_head", "hi_head")

    shared = keyed(_first_rows(own, edits, least), most).select("key", "id")
    # most keys are of one line only: what is left after one shuffle is small, and only for that more than a count is worked out
    shared = shared.select("*", F.count("*").over(same).alias("size")).where("size > 1")
    shared = shared.select("*", F.min("id").over(same).alias("centre"), F.max("id").over(same).alias("hi")).where("centre < hi")
    none = F.lit(0).alias("seg"), F.lit(0).cast("long").alias("head")
    shared = written(shared.select("key", "id", "centre", "size", F.col("id").alias("component"), *none).distinct(), "line-keys")
    texts = _texts(own, shared.select("id").distinct())
    links = written(_verified(_candidates(shared, texts, edits), texts, edits), "line-links")
    crowd, known = shared.where(F.col("size") > SMALL).select("key", "id"), None
    while crowd.head(1):
        labels = connected_components(links, "a", "b", in_task=0).select(F.col("node").alias("id"), F.col("component").alias("label"))
        lines_of = texts.select("id", "line")
        if known is None:  # the first keys again, with their places in the lines
            known = keyed(_first_rows(lines_of.join(crowd.select("id").distinct(), "id", "left_semi"), edits, least), most).join(crowd, ["key", "id"], "left_semi")
        else:
            known = known.drop("component").join(lines_of, "id")
        known = bucketed(known.join(labels, "id", "left").withColumn("component", F.coalesce("label", "id"))).drop("centre", "size")
        rows = written(rest(known), "line-parts")
        done = rows.where("nominal = 0").select(F.col("chain").alias("key"), "id", F.lit(None).cast("long").alias("centre"), F.lit(0).cast("long").alias("size"), "component", *none)
        known = written(bucketed(keyed(rows.where("nominal > 0").join(lines_of, "id"), most)).select("id", "component", "key", "seg", "far", "start", "width", "a", "b", "nominal", "edits", "head", "centre", "size"), "line-keys")
        found = _candidates(known.select(shared.columns).union(done.select(shared.columns)), texts, edits)
        links = written(links.union(_verified(found, texts, edits)), "line-links")
        known = known.where(F.col("size") > SMALL).drop("centre", "size")
        crowd = known
    return links


def _place() -> Column:
    """doc and at in one number, which hash aggregation can take the least of."""
    return F.col("doc").cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(12,0)") + F.col("at").cast("decimal(12,0)")


def dropped(docs: DataFrame, edits: int | None = None, least: int = LEAST, shortest: int | None = None) -> DataFrame:
    """(doc, at, class): the lines that repeat an earlier one; class is the hash of the class's representative."""
    found = lines(docs, least if shortest is None else shortest)
    # a line is a key and the rest are numbers, so that lines are aggregated by hash before and after the shuffle
    own = found.groupBy("line").agg(F.min(_place().cast("decimal(38,0)")).alias("first"), F.count("*").alias("n"))
    own = written(own.select(F.xxhash64("line").alias("id"), "first", "n", "line"), "lines", "zstd")
    near = near_pairs(own.select("id", "line"), edits, least)
    labels = connected_components(near, "a", "b", in_task=0).select(F.col("node").alias("id"), "component")
    shared = own.select("id", "n", "first").join(labels, "id", "left").where("n > 1 or component is not null").withColumn("class", F.coalesce("component", "id"))
    firsts = shared.groupBy("class").agg(F.min("first").alias("first"))
    shared = written(shared.select("id", "class").join(firsts, "class"), "classes")
    places = found.select("doc", "at", F.xxhash64("line").alias("id")).join(shared, "id")
    return places.where(_place() != F.col("first")).select("doc", "at", "class")


def report(docs: DataFrame, edits: int | None = None, least: int = LEAST, shortest: int | None = None) -> DataFrame:
    """One row per doc_id: (doc_id, n_lines, n_dropped, dropped), dropped being the line numbers, from 0, joined by commas."""
    gone = dropped(docs, edits, least, shortest).distinct().groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("at"))
    doc = F.coalesce(F.col(DOC_ID).cast("long"), F.lit(_LAST_DOC))
    own = F.coalesce(TEXT, F.lit(""))
    sizes = docs.select(doc.alias("doc"), (F.octet_length(own) - F.octet_length(F.replace(own, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n")).groupBy("doc").agg(F.max("n").alias("n_lines"))
    return sizes.join(gone, "doc", "left").select(F.nullif("doc", F.lit(_LAST_DOC)).alias("doc_id"), "n_lines", F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("at", ","), F.lit("")).alias("dropped"))


def without_repeated_lines(docs: DataFrame, edits: int | None = None, least: int = LEAST, shortest: int | None = None) -> DataFrame:
    """docs, same columns, without the lines that repeat an earlier one; a document of which nothing is left goes."""
    gone = dropped(docs, edits, least, shortest).groupBy("doc").agg(F.collect_set("at").alias("__gone"))
    names = docs.columns
    doc = F.coalesce(docs[DOC_ID].cast("long"), F.lit(_LAST_DOC))
    parts = F.split(F.coalesce(docs[TEXT], F.lit("")), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    new = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    out = docs.join(gone, doc == gone["doc"], "left").withColumn("__text", F.when(F.col("__gone").isNotNull(), new))
    out = out.where("__gone is null or trim(__text) <> ''")
    chars = {"n_chars": F.coalesce(F.length("__text").cast(docs.schema["n_chars"].dataType), docs["n_chars"]).alias("n_chars")} if "n_chars" in names else {}
    return out.select(*(F.coalesce("__text", docs[TEXT]).alias(TEXT) if c == TEXT else chars.get(c, docs[c]) for c in names))
