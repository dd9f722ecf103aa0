r"""Line dedup by a segment-partition edit join (operator 5), with DataFrame and SQL functions only.

Lines are the parts of a text between newlines. Among all occurrences, a line stays only at its first place (smallest
doc_id, then place). A line of at least ``min_chars`` characters doesn't stay even there if a different line of that
length, within ``tau`` edits (insert, delete, replace of a character), has an earlier first place.

1. Occurrences are reduced to distinct lines by a 128-bit hash, with their first place and their keys; no text moves.
2. A line of length l is cut into tau + 1 segments of fixed places. A line within tau edits has at least one of them as
   a substring, at a place that the multi-match-aware bounds narrow to a few for each length l .. l + tau. Equal
   substrings that stand for several lengths are one key, so a line has at most eight keys for two edits.
3. Keys are counted first. A key of two lines is a pair already; the lines of a key with up to ``hot`` lines are joined.
   Only rows whose key may have several lines, by a bitmap of such keys, are shuffled for that.
4. A key of more lines never gives all its pairs. They have a pivot, the commonest line around (see ``pivots``); later
   lines within tau edits of it are settled. Every other line gives second keys, relative to the pivot, that two lines
   share only if they are alike where they differ from the pivot (see ``second_keys``), and meets only the lines that
   have one of them.
5. Texts are fetched for candidate lines only (a bitmap of their hashes, sized by their count and bounded, is broadcast
   and keeps most others from being shuffled), then pairs are checked: most pieces of finer and finer partitions must be
   intact (a necessary condition), then a banded bit-parallel edit distance decides. Its column vector holds the
   2 * tau + 1 diagonals of the band as bits of one integer.
6. The commonest lines are looked up where rows are read; rows that lose no others need no join. ``dedup`` joins only the
   rest of the rows that lose lines with those places; the others are passed on where they are read.

Defined results: a null text has no lines and stays null; null identifiers count as the smallest; rows with equal
identifier and text count as one place, so both keep what either keeps; lines without a word always stay if they are
shorter than ``min_chars``; lines and texts of any length are taken whole; an empty table gives no rows; other columns,
whatever they are called, are carried along by ``dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from millrace.llm import _scratch as sc

#: Numbers of pieces of a line that must nearly all be intact before its distance is computed.
FINER = (4, 8, 24)
TAU, MIN_CHARS, HOT = 2, 20, 32
#: Rounds in which hot keys learn of commoner lines than their own.
PIVOT_ROUNDS = 4
#: Lines, the commonest, whose places are found where rows are read; for all others a join tells rows their places.
COMMON = 256
#: A bitmap's buckets of 32,768 bits: 16 bits an entry, 64 MB at most.
MOST_BUCKETS = 16_384


def segment(length: str, i: int, n: int) -> tuple[str, str]:
    """(start, size) in SQL of the i-th of n even segments of a line, the longer ones last; places count from 1."""
    small, extra = f"({length} div {n})", f"({length} % {n})"
    late = f"greatest(0, {i} - 1 - ({n} - {extra}))"
    size = f"({small} + if({i} > {n} - {extra}, 1, 0))"
    return f"(1 + ({i} - 1) * {small} + {late})", size


def shifts(delta: int, i: int, tau: int) -> range:
    """Where a segment may have moved to in a line longer by delta: the multi-match-aware bounds."""
    return range(max(-(i - 1), delta - (tau + 1 - i)), min(i - 1, delta + (tau + 1 - i)) + 1)


def substrings(tau: int, r: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) of the substrings that a line gives as keys, its own segments first.

    The line has (tau + 1) * q + r characters; start counts from (segment - 1) * q, size from q. A substring's size
    tells the other line's length up to tau, so equal ones for several lengths are one.
    """
    n, out = tau + 1, []
    for delta in range(tau + 1):
        less, extra = (1, r - delta + n) if r < delta else (0, r - delta)
        for i in range(1, n + 1):
            start, size = -(i - 1) * less + max(0, i - 1 - (n - extra)), -less + (i > n - extra)
            out += [(i, start + d, size) for d in shifts(delta, i, tau)] if delta else [(i, start, size)]
    out += [(i, start + d, size) for i, start, size in out[:n] for d in shifts(0, i, tau)]
    return list(dict.fromkeys(out))


def line_keys(tau: int, line: str = "_line", length: str = "_len", seed: str = "") -> list[str]:
    """SQL of a line's keys, null where it has fewer; the first tau + 1 are its own segments."""
    n = tau + 1
    of = [substrings(tau, r) for r in range(n)]
    keys = []
    for slot in range(max(map(len, of))):
        cases = []
        for r, subs in enumerate(of):
            if slot < len(subs):
                i, start, size = subs[slot]
                cases.append(f"WHEN {r} THEN xxhash64({seed}{i}, substring({line}, {i - 1} * ({length} div {n}) + {start + 1}, ({length} div {n}) + {size}))")
        keys.append(f"CASE {length} % {n} {' '.join(cases)} END")
    return keys


def agreement(x: str, e: str) -> str:
    """SQL of the number of characters at which two strings begin alike, by halving steps."""
    n = f"length(bin(length({e})))"
    alike = f"p + w <= least(length({x}), length({e})) AND substring({x}, p + 1, w) = substring({e}, p + 1, w)"
    return f"aggregate(transform(sequence(1, {n}), k -> shiftleft(1, {n} - k)), 0, (p, w) -> if({alike}, p + w, p))"


def repairs(x: str, e: str) -> str:
    """SQL of the strings that one edit makes of x, at the first character where it differs from e, towards e."""
    both, cut = f"p < length({x}) AND p < length({e})", f"substring({x}, 1, p)"
    ways = [
        f"if({both}, concat({cut}, substring({e}, p + 1, 1), substring({x}, p + 2)), null)",
        f"if(p < length({x}), concat({cut}, substring({x}, p + 2)), null)",
        f"if(p < length({e}), concat({cut}, substring({e}, p + 1, 1), substring({x}, p + 1)), null)",
    ]
    return f"filter(transform(array({agreement(x, e)}), p -> array({', '.join(ways)}))[0], y -> y IS NOT NULL)"


def second_keys(members: DataFrame, tau: int) -> DataFrame:
    """members (key, _line, _e, others) -> (others, key2): keys relative to the pivot ``_e``, shared by any two members within tau edits.

    Let two members agree with the pivot for p and p' characters at the start, s and s' at the end. If p < p', the
    first place where they differ is p, there the second agrees with the pivot, and some shortest way from the first to
    the second starts with one edit there: one of ``repairs``. So it is at the end for s < s', with reversed strings.
    If p = p' and s = s', what differs lies between. Hence after at most tau such repairs, dealt in some way to the two,
    either both are equal, or they have equal p and s and what lies between is within the edits that are left, and is
    partitioned into segments in turn. What a line shares with the pivot is never a key.
    """
    def ends(df: DataFrame) -> DataFrame:
        return df.withColumn("_p", F.expr(agreement("_line", "_e"))).withColumn("_s", F.expr(agreement("reverse(_line)", "reverse(_e)")))

    others = [c for c in members.columns if c not in ("key", "_line", "_e")]
    out, level = None, members.select("key", *others, "_line", "_e")
    for used in range(tau + 1):
        keys = ["xxhash64(key, 0, _line)"]
        df = level
        if used < tau:
            df = ends(level).withColumn("_mid", F.expr("substring(_line, _p + 1, greatest(0, length(_line) - _p - _s))"))
        for left in range(1, tau - used + 1):
            keys += line_keys(left, "_mid", "length(_mid)", f"key, {left}, _p, _s, ")
        given = df.select(*others, F.explode(F.expr(f"array_distinct(array({', '.join(keys)}))")).alias("key2")).where("key2 IS NOT NULL")
        out = given if out is None else out.unionByName(given)
        if used < tau:
            ends_too = f"transform({repairs('reverse(_line)', 'reverse(_e)')}, z -> reverse(z))"
            level = level.select("key", *others, F.explode(F.expr(f"array_distinct(concat({repairs('_line', '_e')}, {ends_too}))")).alias("_line"), "_e")
    return out


def edit_distance(a: str, b: str, tau: int) -> Column:
    """Banded bit-parallel edit distance of two strings, len(a) <= len(b) <= len(a) + tau; exact up to tau.

    Bit k of the vectors stands for row j - tau + k of column j. Vertical differences start as +1 below row 0 and -1
    above it; a diagonal's value grows by one where its zero-difference bit is clear, so only the diagonal that ends in
    the last cell is summed.
    """
    columns = f"struct(split({a}, '') AS a, split({b}, '') AS b)"
    a, b, width = "(p.a)", "(p.b)", 2 * tau + 1
    full = (1 << width) - 1
    up = (1 << tau) - 1
    eq = " | ".join(f"if(get({a}, j - 1 - {tau} + {k}) <=> {b}[j - 1], {1 << k}, 0)" for k in range(width))
    gap = f"(size({b}) - size({a}))"
    step = f"named_struct('e', {eq}, 'vp', s.vp, 'vn', s.vn, 'n', s.n)"
    d0 = "named_struct('d', ((((x.e & x.vp) + x.vp) ^ x.vp) | x.e | x.vn) & %d, 'vp', x.vp, 'vn', x.vn, 'n', x.n)" % full
    hs = "named_struct('d', y.d, 'hp', (y.vn | ~(y.d | y.vp)) & %d, 'hn', y.d & y.vp, 'n', y.n)" % full
    end = f"named_struct('vp', (z.hn | ~(shiftright(z.d, 1) | z.hp)) & {full}, 'vn', shiftright(z.d, 1) & z.hp, 'n', z.n + if(j > {gap}, 1 - (shiftright(z.d, {tau} - {gap}) & 1), 0))"
    # Each inner transform over a one-element array names a step's result, so nothing is evaluated twice.
    inner = f"transform(transform(transform(array({step}), x -> {d0}), y -> {hs}), z -> {end})[0]"
    walk = f"aggregate(sequence(1, size({b})), named_struct('vp', {full - up}, 'vn', {up}, 'n', {gap}), (s, j) -> if(s.n > {tau}, s, {inner}), s -> s.n)"
    # The strings are split once, outside the walk: as a lambda's argument they can't be copied into its steps.
    return F.expr(f"transform(array({columns}), p -> if(size({b}) = 0, 0, {walk}))[0]")


def alike(pairs: DataFrame, a: str, b: str, tau: int) -> DataFrame:
    """Those rows whose strings ``a`` and ``b`` are within tau edits."""
    pairs = pairs.withColumn("_x", F.expr(f"if(length({a}) <= length({b}), {a}, {b})")).withColumn("_y", F.expr(f"if(length({a}) <= length({b}), {b}, {a})"))

    def intact(n: int) -> str:
        """All but tau of n pieces of the shorter line stand in the longer one, at most tau away."""
        found = []
        for i in range(1, n + 1):
            at, size = segment("length(_x)", i, n)
            found.append(f"if(instr(substring(_y, greatest(1, {at} - {tau}), {size} + {tau} + least({tau}, {at} - 1)), substring(_x, {at}, {size})) > 0, 1, 0)")
        return f"{' + '.join(found)} >= {n - tau}"

    pairs = pairs.where(" AND ".join([f"length(_y) - length(_x) <= {tau}", *(intact(n) for n in FINER if n > tau)]))
    return pairs.where(edit_distance("_x", "_y", tau) <= tau).drop("_x", "_y")


def first_place(doc_id: str, th: str) -> str:
    """SQL of the place of a row's line 0."""
    base = f"cast(coalesce({doc_id}, {-(1 << 63)}L) as decimal(19, 0)) * 10000000000000000000BD + cast(pmod({th}, 900000000L) * 10000000000L as decimal(19, 0))"
    return f"cast({base} as decimal(38, 0))"


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, n, place, _line, _len, h, g) of every line that takes part. ``th`` tells rows of one identifier apart;
    ``place`` orders occurrences by identifier, th and n; h and g name the line."""
    th = F.xxhash64("text")
    lines = docs.withColumn("th", th).withColumn("_base", F.expr(first_place("doc_id", "th")))
    lines = lines.select("doc_id", "th", "_base", F.posexplode(F.split("text", "\n")).alias("n", "_line")).withColumn("_len", F.length("_line"))
    lines = lines.where(f"_len >= {min_chars} OR _line RLIKE '[^ \\\\t-\\\\r]'")
    return lines.withColumns({"place": F.expr("cast(_base + n as decimal(38, 0))"), "h": F.xxhash64("_line"), "g": F.xxhash64(F.lit(1), "_line")}).drop("_base")


def bitmap(hashes: DataFrame, path: str) -> tuple[DataFrame, int]:
    """A written set of hashes ``h`` (a table) modulo a number of bits that goes by their count: ((_bucket, _bits), buckets).

    ``marked`` may name rows that weren't meant, never miss one; where the bound makes it name many, a join decides later.
    """
    buckets, n = 1, sc.count(hashes)
    while buckets < MOST_BUCKETS and buckets * 2048 < n:
        buckets = min(MOST_BUCKETS, 4 * buckets)
    slots = hashes.select(F.pmod(F.col("h"), F.lit(buckets * 32768)).alias("_slot"))
    bits = slots.groupBy(F.expr("cast(_slot div 32768 as int)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_slot % 32768 + 1))").alias("_bits"))
    return sc.save(bits, path), buckets


def marked(df: DataFrame, of: tuple[DataFrame, int], name: str) -> DataFrame:
    """Adds a boolean: whether the row's ``h`` may be in the bitmap."""
    bits, buckets = of
    slot = F.pmod(F.col("h"), F.lit(buckets * 32768))
    out = df.withColumn("_slot", slot).withColumn("_bucket", F.expr("cast(_slot div 32768 as int)")).join(F.broadcast(bits), "_bucket", "left")
    byte = "conv(hex(substring(_bits, cast((_slot % 32768) div 8 as int) + 1, 1)), 16, 10)"
    return out.withColumn(name, F.expr(f"coalesce(({byte} & shiftleft(1, cast(_slot % 8 as int))) <> 0, false)")).drop("_slot", "_bucket", "_bits")


def candidates(firsts: DataFrame, path: str, tau: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """((a, b), (key, h)): pairs of lines with a common key, and the lines of keys that too many have."""
    slots = [c for c in firsts.columns if c.startswith("_k")]
    rows = firsts.select("h", F.posexplode(F.array(*slots)).alias("pos", "key")).where("key IS NOT NULL")
    met = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.min("pos").alias("least"))
    met = sc.save(met.where(f"c > 1 AND lo <> hi AND least <= {tau}"), f"{path}/met")
    several = met.where("c > 2").select("key", (F.col("c") > hot).alias("hot"))
    # Most keys are one line's own: a bitmap keeps them from being shuffled a second time.
    sieve = bitmap(several.select(F.col("key").alias("h")), f"{path}/several")
    likely = marked(rows.select(F.col("h").alias("_line"), "pos", F.col("key").alias("h")), sieve, "_likely").where("_likely")
    likely = likely.select(F.col("h").alias("key"), F.col("_line").alias("h"), "pos")
    member = sc.save(likely.join(several, "key").select("key", "h", (F.col("pos") <= tau).alias("own"), "hot"), f"{path}/members")
    few = member.where("NOT hot").select("key", "h", "own")
    other = few.select("key", F.col("h").alias("b"), F.col("own").alias("too"))
    joined = few.where("own").withColumnRenamed("h", "a").join(other, "key").where("a < b OR (a <> b AND NOT too)")
    pairs = joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(met.where("c = 2").select("lo", "hi")).distinct()
    return sc.save(pairs, f"{path}/candidates"), member.where("hot").select("key", "h").distinct()


def later(pairs: DataFrame, texts: DataFrame, path: str, tau: int) -> DataFrame:
    """(h, g) of the later line of each pair (a, b) that is within tau edits.

    The texts are written beside their pairs first, here and in ``hot_pairs``: Spark plans a query anew after each of its
    shuffles, so the driver's memory holds the long expressions of ``alike`` once where no shuffle shares their query.
    """
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("h").alias(side), F.struct("h", "g").alias(f"_{side}"), F.col("_line").alias(f"_l{side}"), F.col("first").alias(f"_f{side}")), side)
    both = sc.save(pairs.select(F.expr("if(_fa > _fb, _a, _b)").alias("x"), "_la", "_lb").repartition(sc.parts(texts.sparkSession)), path)
    return sc.save(alike(both, "_la", "_lb", tau).select("x.*"), f"{path}-near").distinct()


def pivots(member: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """(key, h) -> (key, _at, h): key is now the line that a hot key's lines are compared with first, _at its place.

    The best pivot is the text that the others are variants of, which need not have the key itself (its length may lie
    outside the key's). So in PIVOT_ROUNDS rounds each key takes the commonest line that any of its lines knows of, the
    earliest of equal ones, and each line the commonest that any of its keys knows of. Keys of one pivot count as one.
    """
    known = member.join(texts.select("h", F.struct("times", (-F.col("first")).alias("early"), F.col("h").alias("eh")).alias("e")), "h")
    for k in range(PIVOT_ROUNDS):
        known = sc.save(known.groupBy("key").agg(F.max("e").alias("e")), f"{path}/pivots-{k}")
        known = member.join(known, "key")
        if k < PIVOT_ROUNDS - 1:
            known = member.join(known.groupBy("h").agg(F.max("e").alias("e")), "h")
    return sc.save(known.select(F.col("e.eh").alias("key"), (-F.col("e.early")).alias("_at"), "h").distinct(), f"{path}/hot")


def hot_pairs(member: DataFrame, texts: DataFrame, path: str, tau: int) -> tuple[DataFrame, DataFrame]:
    """((h, g), (a, b)): lines of hot keys that have an earlier line within tau edits, a pivot or its member; pairs of lines to be checked."""
    once = pivots(member, texts, path)
    e = texts.select(F.col("h").alias("key"), F.col("first").alias("_at"), F.col("_line").alias("_e"))
    member = once.join(texts.drop("times"), "h").join(e, ["key", "_at"]).repartition(sc.parts(once.sparkSession))
    member = sc.save(member, f"{path}/hot-texts")
    close = alike(member.where("first <> _at"), "_line", "_e", tau)
    close = sc.save(close.select("h", "g", "first", "key", "_at"), f"{path}/close")
    settled = close.where("first > _at").select("h", "g").distinct()
    pivot = close.where("first < _at").select(F.col("key").alias("h"), F.col("_at").alias("first")).distinct().join(texts, ["h", "first"]).select("h", "g")
    keyed = sc.save(second_keys(member.select("key", "h", "g", "_line", "_e"), tau), f"{path}/second")
    keyed = keyed.join(settled.withColumn("_settled", F.lit(True)), ["h", "g"], "left").select("key2", "h", F.col("_settled").isNull().alias("free"))
    other = keyed.select("key2", F.col("h").alias("b"), F.col("free").alias("too"))
    pairs = keyed.where("free").select("key2", F.col("h").alias("a")).join(other, "key2").where("a < b OR (a <> b AND NOT too)")
    pairs = sc.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{path}/second-pairs")
    return settled.union(pivot), pairs


def common_places(common: list[Row], text: str, doc_id: str, th: str) -> str:
    """SQL of the places at which a row loses one of the lines ``common`` (h, g, first, near), no two of the same h."""
    if not common:
        return f"if({text} IS NULL, null, cast(array() as array<int>))"
    h = ", ".join(f"{x.h}L" for x in common)
    of = {"g": ", ".join(f"{x.g}L" for x in common), "near": ", ".join(str(x.near) for x in common), "first": ", ".join(f"cast('{x.first}' as decimal(38, 0))" for x in common)}
    lost = f"array({of['g']})[s.i - 1] = s.g AND (array({of['near']})[s.i - 1] OR array({of['first']})[s.i - 1] <> cast({first_place(doc_id, th)} + s.n as decimal(38, 0)))"
    found = f"transform(split({text}, '\n'), (x, n) -> if(xxhash64(x) IN ({h}), named_struct('n', n, 'i', cast(array_position(array({h}), xxhash64(x)) as int), 'g', xxhash64(1, x)), null))"
    return f"transform(filter(filter({found}, s -> s IS NOT NULL), s -> {lost}), s -> s.n)"


def lost_lines(occ: DataFrame, path: str, tau: int, min_chars: int, hot: int) -> DataFrame:
    """(h, g, first, times, near) of the lines that places lose: all but the first, or with ``near`` that too. A written table."""
    keys = {f"_k{j}": F.expr(f"if(_len >= {min_chars}, {k}, null)") for j, k in enumerate(line_keys(tau))}
    firsts = occ.withColumns(keys).groupBy("h", "g").agg(F.min("place").alias("first"), F.count("*").alias("times"), *[F.max(k).alias(k) for k in keys])
    firsts = sc.save(firsts, f"{path}/firsts")
    pairs, heavy = candidates(firsts, path, tau, hot)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).union(heavy.select("h")).distinct()
    texts = marked(occ.where(f"_len >= {min_chars}"), bitmap(sc.save(wanted, f"{path}/wanted"), f"{path}/bits"), "_wanted").where("_wanted")
    texts = texts.groupBy("h", "g").agg(F.min(F.struct("place", "_line")).alias("x"), F.count("*").alias("times")).select("h", "g", F.col("x.place").alias("first"), F.col("x._line").alias("_line"), "times")
    texts = sc.save(texts, f"{path}/texts")
    if heavy.limit(1).count():
        settled, more = hot_pairs(heavy, texts, path, tau)
        late = later(pairs.union(more).distinct(), texts, f"{path}/pair-texts", tau).union(settled)
    else:
        late = later(pairs, texts, f"{path}/pair-texts", tau)
    late = sc.save(late.distinct().withColumn("near", F.lit(True)), f"{path}/late")
    lost = firsts.select("h", "g", "first", "times").join(late, ["h", "g"], "left").where("times > 1 OR near")
    return sc.save(lost.withColumn("near", F.coalesce("near", F.lit(False))), f"{path}/lost")


def places(docs: DataFrame, tau: int, min_chars: int, hot: int, most: int) -> tuple[DataFrame, list[Row]]:
    """(doc_id, th, gone): for rows that lose lines, the places of those lines, a written table; without those of up to
    ``most`` common lines, which come as rows (h, g, first, times, near)."""
    kept = sc.new_dir(docs.sparkSession, "lines")
    path = f"{kept}/work"
    occ = occurrences(docs.select("doc_id", F.col("text").cast("string").alias("text")), min_chars)
    lost = lost_lines(occ, path, tau, min_chars, hot)
    common = list({x.h: x for x in lost.orderBy(F.desc("times"), "h", "g").limit(most).collect()}.values()) if most else []
    if common:
        of = {c: ", ".join(f"{x[c]}L" for x in common) for c in "hg"}
        lost = lost.where(f"NOT coalesce(get(array({of['g']}), cast(array_position(array({of['h']}), h) as int) - 1) = g, false)")
    # Most places lose nothing: a bitmap keeps them from being shuffled.
    likely = marked(occ.select("doc_id", "th", "n", "place", "h", "g"), bitmap(lost.select("h"), f"{path}/lost-bits"), "_lost").where("_lost")
    gone = likely.join(lost.select("h", "g", "first", "near"), ["h", "g"]).where("near OR place <> first")
    gone = sc.save(gone.groupBy("doc_id", "th").agg(F.collect_set("n").alias("gone")), f"{kept}/gone")
    sc.drop_dir(docs.sparkSession, path)
    return gone, common


def removed_places(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """(doc_id, th, gone): for rows that lose lines, the places of those lines. A written table."""
    return places(docs, tau, min_chars, hot, 0)[0]


def dedup(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, hot: int = HOT, counts: bool = True) -> DataFrame:
    """The same rows and columns without the removed lines, with ``counts`` also `_n_lines` and `_n_removed`."""
    gone, common = places(docs, tau, min_chars, hot, COMMON)
    bits = bitmap(gone.select(F.col("th").alias("h")), f"{sc.new_dir(docs.sparkSession, 'lines')}/rows")
    text = F.col("_row.text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    rows = marked(rows, bits, "_loses").withColumn("_gone", F.expr(common_places(common, "cast(_row.text AS string)", "_doc", "h")))
    told = gone.select(F.col("doc_id").alias("_gdoc"), F.col("th").alias("_gth"), F.col("gone").alias("_places"))
    some = rows.where("_loses").join(told, F.col("_doc").eqNullSafe(F.col("_gdoc")) & (F.col("h") == F.col("_gth")), "left")
    both = rows.where("NOT _loses").select("_row", "_gone").union(some.select("_row", F.expr("concat(_gone, coalesce(_places, cast(array() as array<int>)))")))
    # As a lambda's argument the lines are split once a row.
    cut = "transform(array(split(cast(_row.text AS string), '\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), _gone), i -> l[i]), '\n'))[0]"
    left = F.when(F.expr("_gone IS NULL OR size(_gone) = 0"), text).otherwise(F.expr(cut))
    cols = [left.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    if not counts:
        return both.select(*cols)
    n_lines = F.size(F.split(text, "\n"))
    return both.select(*cols, F.coalesce(n_lines, F.lit(0)).cast("long").alias("_n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("_n_removed"))


def oracle(tau: int = TAU, min_chars: int = MIN_CHARS) -> str:
    """The query's digest in DuckDB's SQL."""
    return rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS n FROM documents WHERE text IS NOT NULL),
    f AS (SELECT x, min((doc_id, n)) AS first, length(x) AS k FROM l WHERE length(x) >= {min_chars} OR regexp_matches(x, '[^ 	-
]') GROUP BY x),
    near AS (SELECT DISTINCT a.x FROM f a JOIN f b ON b.k BETWEEN a.k - {tau} AND a.k + {tau} AND b.first < a.first AND a.x <> b.x
        WHERE a.k >= {min_chars} AND b.k >= {min_chars} AND levenshtein(a.x, b.x) <= {tau}),
    k AS (SELECT l.doc_id, l.n, l.x, f.x IS NOT NULL AND ((l.doc_id, l.n) <> f.first OR near.x IS NOT NULL) AS gone
        FROM l LEFT JOIN f ON l.x = f.x LEFT JOIN near ON l.x = near.x)
    SELECT d.doc_id, CAST(count(k.n) AS BIGINT) AS n_lines, CAST(count(k.n) FILTER (WHERE gone) AS BIGINT) AS n_removed,
        sha256(coalesce(string_agg(k.x, chr(10) ORDER BY k.n) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
    FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id
    """
