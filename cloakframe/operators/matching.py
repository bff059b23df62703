"""Guarded words, phrases and patterns in lines."""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.literals import gram_of, required_literal
from cloakframe.functions.text import GAP, WORD, blank, chunks, context, let, piece, quoted, running, spans, whole_word
from cloakframe.runtime import written

KEY = ["file", "line_num", "part"]
MATCH = [*KEY, "start", "end", "word", "word_lc", "reason", "template", "src", "context"]
SMALL = 5_000  # first tokens of terms that are looked up within the lines; with more of them all tokens meet the terms
MOST_BITS = 1 << 26  # bits that tell which keys are known
INLINE = 16  # patterns that are expressions of their own; more of them are looked up by their literals
_HIT = "struct<start:int,end:int,key:bigint,word_lc:string,src:int,template:string,rx:string>"


@dataclass
class Guard:
    """What to look for: values and patterns with their templates (blank: the default template)."""

    values: dict[str, str] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)
    ignore_values: set[str] = field(default_factory=set)
    ignore_patterns: list[str] = field(default_factory=list)
    default_template: str = "w{hash}"

    def __post_init__(self):
        self.values = merged((k.lower(), v) for k, v in self.values.items())
        self.ignore_values = {v.lower() for v in self.ignore_values}


def merged(pairs) -> dict[str, str]:
    """One template per key: a blank one loses, of others the last wins."""
    out: dict[str, str] = {}
    for k, v in pairs:
        v = (v or "").strip()
        if v or k not in out:
            out[k] = v
    return out


def lines(rows: DataFrame, file: str, text: str) -> DataFrame:
    """file, line_num (from 1) and line; an empty text has no lines, a final line end gives a last empty one."""
    ended = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))  # a plain character is split at without an expression
    rows = rows.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(file).cast("string").alias("file"), F.posexplode(F.split(ended, "\n", -1)).alias("n", "line"))
    return rows.select("file", (F.col("n") + 1).cast("int").alias("line_num"), "line")


def keyed(rows: DataFrame) -> DataFrame:
    """Lines with part (which cell of a record; 0 in texts) and prefix (what its contexts begin with)."""
    part = F.col("part") if "part" in rows.columns else F.lit(0)
    prefix = F.col("prefix") if "prefix" in rows.columns else F.lit("")
    return rows.select("file", "line_num", part.alias("part"), prefix.alias("prefix"), "line")


def tokens(rows: DataFrame) -> DataFrame:
    """Every maximal run of letters and digits with its place."""
    t = rows.select("file", "line_num", F.explode(F.expr(spans("line", quoted(WORD + "+")))).alias("t"))
    return t.select("file", "line_num", "t.start", "t.end", "t.word", F.lower("t.word").alias("word_lc"))


def value_frames(spark: SparkSession, guard: Guard) -> DataFrame:
    """The guard's values, words and phrases, as a table to join."""
    return spark.createDataFrame([(k, v) for k, v in guard.values.items() if k], "word_lc string, template string")


def _key(k: str, words: str) -> str:
    return f"xxhash64({k}, {words})"


def terms(words: DataFrame) -> DataFrame:
    """words with what finds them in a line: k, the number of their tokens, first, the first of these, and key, a hash of all.

    A whole-word match of a term has just its tokens in a row, each a whole token of the line. lead and tail are the
    lengths of what stands before and after them. A term without a token (k 0) is found by its text. overlaps: an
    occurrence of the term may begin within another one.
    """
    t = words.where("word_lc <> ''").select(F.col("word_lc").alias("term"), "template", F.expr(spans("word_lc", quoted(WORD + "+"))).alias("t"))
    t = t.withColumns({"k": F.size("t"), "first": F.expr("get(t, 0).word"), "phrase": F.expr("not (size(t) = 1 and get(t, 0).word = term)")})
    inner = "if(k = 0, term, array_join(transform(t, x -> x.word), '\\u0001'))"
    overlaps = "phrase and length(term) > 1 and exists(sequence(1, greatest(length(term) - 1, 1)), i -> left(term, i) = right(term, i))"
    return t.selectExpr(
        "term", "template", "k", "first", "phrase", f"{_key('k', inner)} as key", "if(k = 0, 0, get(t, 0).start) as lead", "if(k = 0, 0, length(term) - get(t, k - 1).`end`) as tail",
        f"{overlaps} as overlaps", "if(k = 0, length(term), null) as bare",
    )


def _token_hits(ks: list[int], firsts: list[str] | None) -> str:
    """Keys of the runs of k tokens of a line (for each k of ks), of those that begin with one of firsts (None: of all)."""

    def one(t: str) -> str:
        runs = f"transform(array({', '.join(map(str, ks))}), k -> named_struct('start', w.start, 'k', k, 'i', i))"
        fits = f"w.word in ({', '.join(map(quoted, firsts))})" if firsts is not None else "true"
        made = f"flatten(transform({t}, (w, i) -> if({fits}, filter({runs}, r -> r.i + r.k <= size({t})), cast(array() as array<struct<start:int,k:int,i:int>>))))"
        joined = f"if(r.k = 1, get({t}, r.i).word, array_join(transform(sequence(r.i, r.i + r.k - 1), j -> get({t}, j).word), '\\u0001'))"
        return f"transform({made}, r -> cast(named_struct('start', r.start, 'end', get({t}, r.i + r.k - 1).`end`, 'key', {_key('r.k', joined)}, 'word_lc', null, 'src', null, 'template', null, 'rx', null) as {_HIT}))"

    return let(f"transform({spans('line', quoted(WORD + '+'))}, x -> named_struct('start', x.start, 'end', x.`end`, 'word', lower(x.word)))", one)


def _bare_hits(sizes: list[int]) -> str:
    """Keys of the stretches of given sizes between tokens."""
    at = f"flatten(transform(array({', '.join(map(str, sizes))}), n -> if(length(x.word) < n, cast(array() as array<struct<s:int,n:int>>), transform(sequence(0, length(x.word) - n), s -> named_struct('s', s, 'n', n)))))"
    cut = f"cast(named_struct('start', x.start + y.s, 'end', x.start + y.s + y.n, 'key', {_key('0', 'lower(substring(x.word, y.s + 1, y.n))')}, 'word_lc', null, 'src', null, 'template', null, 'rx', null) as {_HIT})"
    return f"flatten(transform({spans('line', quoted(GAP + '+'))}, x -> transform({at}, y -> {cut})))"


def _placed(found: str) -> str:
    """Places in the lower-cased line as places in the line, whose letters may be fewer."""

    def mapped(e: str) -> str:
        return f"transform({found}, s -> named_struct('start', size(filter({e}, q -> q <= s.start)), 'end', size(filter({e}, q -> q < s.`end`)) + 1, 'word', s.word))"

    ends = let("transform(split(line, ''), c -> length(lower(c)))", running)
    return f"if(length(line) = length(lower(line)), {found}, {let(ends, mapped)})"


def _pattern_hits(rx: str, src: str, template: str, low: str = "lower(line)") -> str:
    """Matches of a pattern (SQL text) in the lower-cased line; empty ones don't count."""
    hit = f"cast(named_struct('start', s.start, 'end', s.`end`, 'key', null, 'word_lc', s.word, 'src', {src}, 'template', {template}, 'rx', {rx}) as {_HIT})"
    return let(_placed(spans(low, rx)), lambda v: f"transform(filter({v}, s -> length(s.word) > 0), s -> {hit})")


def _look(patterns: list[str], firsts: list[str]) -> str:
    """The line may have a match of patterns or a token of firsts (or has letters that become more in lower case).

    An expression is tried where a literal stands that all its matches hold, and few tokens are sought as plain text
    before a line is cut up.
    """
    looks = []
    for p in patterns:
        literal = required_literal(p, 1)
        looks.append(f"({f'contains(low, {quoted(literal)}) and ' if literal else ''}low rlike {quoted(p)})")
    if firsts:
        each = ", ".join(map(quoted, firsts))
        if len(firsts) <= INLINE:
            looks.append(f"(({' or '.join(f'contains(low, {quoted(f)})' for f in firsts)}) and arrays_overlap(split(low, {quoted(GAP + '+')}, -1), array({each})))")
        else:
            looks.append(f"exists(split(line, {quoted(GAP + '+')}, -1), w -> lower(w) in ({each}))")
        looks.append("length(line) <> length(low)")
    return f"exists(array(lower(line)), low -> {' or '.join(looks)})" if looks else "false"


def _listed(texts: list[str]) -> str:
    """An array of texts as one literal that is cut up once."""
    used = set("".join(texts))
    mark = next(c for c in map(chr, range(1, 0xD800)) if c not in used and not c.isprintable() and not c.isspace())
    return f"split({quoted(mark.join(texts))}, {quoted(mark)}, -1)"


def _many_pattern_hits(numbered: list[tuple[int, str, str]]) -> str:
    """Matches of many patterns: of those of whose stretch of three letters the line has, without leaving the line's row.

    The stretch comes from a literal that all matches hold; a hash of it says where the numbers of its patterns stand.
    Patterns without such a literal are tried on the lines in which one expression for all of them finds something. All of
    them are a few literals, so that the plan doesn't grow with their number.
    """
    literals = [required_literal(p) for _, p, _ in numbered]
    grams = gram_of([x for x in literals if x])
    rx, template, src = _listed([p for _, p, _ in numbered]), _listed([t for _, _, t in numbered]), f"i + {numbered[0][0]}"
    others = [(i, p) for i, (_, p, _) in enumerate(numbered) if not literals[i]]
    none = "cast(array() as array<int>)"

    def tried(low: str) -> str:
        found = []
        if grams:
            size = 1 << len(grams).bit_length()
            at: list[list[str]] = [[] for _ in range(size)]
            for i, x in enumerate(literals):
                if x:
                    at[zlib.crc32(grams[x].encode()) % size].append(str(i))
            stretches = f"array_distinct(regexp_extract_all({low}, '(?s)(?=(...))', 1))"
            numbers = f"array_join(filter(transform({stretches}, g -> get({_listed([','.join(x) for x in at])}, cast(crc32(cast(g as binary)) % {size} as int))), x -> x <> ''), ',')"
            held = f"i -> contains({low}, get({_listed([x or '' for x in literals])}, i))"
            found.append(let(numbers, lambda v: f"if({v} = '', {none}, filter(transform(array_distinct(split({v}, ',')), x -> cast(x as int)), {held}))"))
        if others:
            plain = all("\\" + d not in p for _, p in others for d in "123456789k")  # numbers of groups would change
            each = f"filter(array({', '.join(str(i) for i, _ in others)}), i -> {low} rlike get({rx}, i))"
            found.append(f"if({low} rlike {quoted('|'.join(f'(?:{p})' for _, p in others))}, {each}, {none})" if plain else each)
        hits = _pattern_hits(f"get({rx}, i)", src, f"get({template}, i)", low)
        return f"flatten(transform(concat({', '.join(found)}), i -> {hits}))"

    return let("lower(line)", tried)


def _perhaps(rows: DataFrame, key: str, known: DataFrame, n: int, probes: int = 1, also: str = "false") -> DataFrame:
    """rows less most of those whose key (a hash) is none of the n known ones (column key), without moving any of them.

    As many bits as probes stand for each known key, in as many longs or twice as many (up to MOST_BITS in all; beyond
    that more rows stay). Some hundredth of the other rows stay by chance, a hundredth of these with each further probe;
    a join with what is known is still to come. Rows that fit also stay, too.
    """
    spark, size = rows.sparkSession, min(max((n * probes - 1).bit_length(), 4), MOST_BITS.bit_length() - 7)
    slot, bit = f"shiftrightunsigned({{}}, {64 - size})", "cast({} & 63 as int)"
    probed = [lambda k, i=i: f"xxhash64({k}, {i})" if i else k for i in range(probes)]
    every = known.select(F.expr(f"explode(array({', '.join(at('key') for at in probed)}))").alias("key"))
    words = every.groupBy(F.expr(slot.format("key")).alias("id")).agg(F.expr(f"bit_or(shiftleft(1L, {bit.format('key')}))").alias("w"))
    bits = spark.range(1 << size).join(words, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")))).alias("w")).select(F.col("w.w").alias("bits"))
    view = f"known_{uuid.uuid4().hex}"
    bits.createOrReplaceTempView(view)
    fits = [f"getbit(get((select bits from {view}), cast({slot.format(at(key))} as int)), {bit.format(at(key))}) = 1" for at in probed]
    try:
        return rows.where(f"({' and '.join(fits)}) or {also}")
    finally:
        spark.catalog.dropTempView(view)


def found_lines(rows: DataFrame, guard: Guard, words: DataFrame | None = None, keep: int = 15) -> DataFrame:
    """Lines (file, line_num, part, prefix, line) that may have a match, and ms: their matches less the ignored, by place.

    words replaces the guard's values. A line gives a key for each run of as many tokens as some term has; keys meet
    the terms in a join, so that the work follows the tokens of the lines and the true matches, however many terms begin
    alike. Lines without any first token of a term are dropped within the scan: with few first tokens they are sought, and
    runs that begin otherwise are dropped; with many, bits tell which lines may have one, and which runs may be terms. Of a term's occurrences that overlap each other those count that a search from
    left to right finds, each beginning where the last one ended. file, line_num and part tell lines apart.
    """
    rows, spark = keyed(rows), rows.sparkSession
    every = terms(words if words is not None else value_frames(spark, guard))
    shapes = every.select("k", "first", "bare").distinct().limit(SMALL + 1).collect()
    small = len(shapes) <= SMALL
    if small:
        ks, bare = ({r[c] for r in shapes} - {0, None} for c in ("k", "bare"))
    else:
        every = written(every, "terms")
        ks, bare, n = every.agg(F.collect_set("k"), F.collect_set("bare"), F.count("key")).first()
        ks, bare = set(ks or []) - {0}, set(bare or []) - {0}
    firsts = sorted({r.first for r in shapes if r.first is not None}) if small else None
    numbered = [(i + 2, p, (t or "").strip()) for i, (p, t) in enumerate(guard.patterns.items())]
    inline = numbered if len(numbered) <= INLINE else []

    keyed_parts = [_token_hits(sorted(ks), firsts)] * bool(ks) + [_bare_hits(sorted(bare))] * bool(bare)
    parts = [_pattern_hits(quoted(p), str(i), quoted(t)) for i, p, t in inline]
    if inline != numbered:
        parts.append(_many_pattern_hits(numbered))
    hits = lambda xs: f"concat({', '.join(xs)})" if xs else f"cast(array() as array<{_HIT}>)"
    some = rows
    if not bare and inline == numbered:  # a cheap look at each line first
        look = _look([p for _, p, _ in inline], firsts or [])
        if small:
            some = rows.where(look)
        elif ks:  # keys of runs are made in lines that may have a first token of some term
            token = rows.select(*KEY, F.explode(F.split("line", GAP + "+", -1)).alias("w")).withColumn("first", F.expr("xxhash64(lower(w))"))
            near = written(_perhaps(token, "first", every.where("k > 0").select(F.xxhash64("first").alias("key")).distinct(), n, 3).select(F.xxhash64(*KEY).alias("key")).distinct(), "near")
            some = _perhaps(rows.withColumn("id", F.xxhash64(*KEY)), "id", near, near.count(), also=look).drop("id")

    def merged_rows(hits: DataFrame, *also: Column) -> DataFrame:
        """The matches of each line, less the ignored (a row that is none of them still brings its line)."""
        own = F.col("key").isNotNull()
        hits = hits.withColumns({
            "start": F.when(own, F.col("start") - F.col("lead")).otherwise(F.col("start")), "end": F.when(own, F.col("end") + F.col("tail")).otherwise(F.col("end")),
            "src": F.when(own, F.col("phrase").cast("int")).otherwise(F.col("src")), "word_lc": F.coalesce(F.when(own, F.col("term")), "word_lc"), "template": F.coalesce(F.when(own, F.col("term_template")), "template"),
        })
        good = "start >= 0 and src is not null"
        if guard.ignore_values:
            good += f" and word_lc not in ({', '.join(map(quoted, sorted(guard.ignore_values)))})"
        good += "".join(f" and not word_lc rlike {quoted(p)}" for p in guard.ignore_patterns)
        m = F.expr(f"if({good}, struct(start, end, src, word_lc, template, rx, coalesce(overlaps, false) as overlaps), null)")
        return hits.groupBy(*KEY).agg(*also, F.sort_array(F.collect_list(m)).alias("ms"))

    table = every.select("key", "term", F.col("template").alias("term_template"), "phrase", "lead", "tail", "overlaps")
    lookups = {"term": "string", "term_template": "string", "phrase": "boolean", "lead": "int", "tail": "int", "overlaps": "boolean"}
    bare_row = lambda df: df.withColumns({c: F.lit(None).cast(t) for c, t in lookups.items()})
    if small or not keyed_parts:  # the first hit brings the line along
        hit = some.select(*KEY, "prefix", "line", F.expr(f"posexplode({hits(keyed_parts + parts)}) as (i, t)")).select(*KEY, F.expr("if(i = 0, prefix, null)").alias("prefix"), F.expr("if(i = 0, line, null)").alias("line"), "t.*")
        if keyed_parts:  # matches of patterns have no key: dealt by what they are, they don't meet in one task
            probe = F.coalesce("key", F.xxhash64(*KEY, "start"))
            hit = hit.withColumn("probe", probe).join(table.withColumnRenamed("key", "probe"), "probe", "left")
        else:
            hit = bare_row(hit)
        per = merged_rows(hit, F.first("prefix", True).alias("prefix"), F.first("line", True).alias("line")).where(F.size("ms") > 0)
    else:  # only hits that may be a term's go on, and only lines that have some
        each = lambda xs: some.select(*KEY, F.expr(f"explode({hits(xs)})").alias("t")).select(*KEY, "t.*")
        hit = _perhaps(each(keyed_parts), "key", every, n).join(table, "key")
        if parts:
            hit = hit.unionByName(bare_row(each(parts)))
        per = written(merged_rows(hit).where(F.size("ms") > 0), "hits")
        known = per.select(F.xxhash64(*KEY).alias("key"))
        per = per.join(_perhaps(rows.withColumn("id", F.xxhash64(*KEY)), "id", known, known.count()).drop("id"), KEY)

    # phrases are compared letter by letter, and what is no word has no letter or digit beside it
    cut = f"named_struct('parts', {chunks('line')}, 'n', length(line))"
    same = lambda v: f"(m.src <> 1 or (m.`end` <= {v}.n and lower({piece(f'{v}.parts', 'm.start', 'm.`end` - m.start')}) = m.word_lc))"
    kept = let(cut, lambda v: f"filter(ms, m -> m.src = 0 or ({same(v)} and {whole_word(f'{v}.parts', 'm.start', 'm.`end`')}))")
    per = _settled(per, f"if(exists(ms, m -> m.src > 0), {kept}, ms)")
    per = _settled(per, f"if(exists(ms, m -> m.overlaps), {_left_to_right()}, ms)")
    per = _settled(per, f"if(exists(ms, m -> m.src > 0), {_told_once()}, ms)")
    reason = "if(m.src < 2, concat('Value ', m.word_lc), concat('Pattern ', m.rx))"
    shown = let(cut, lambda v: f"""transform(ms, m -> named_struct('start', m.start, 'end', m.`end`, 'word', {piece(f'{v}.parts', 'm.start', 'm.`end` - m.start')}, 'word_lc', m.word_lc,
        'reason', {reason}, 'template', m.template, 'src', m.src, 'context', concat(prefix, {context(f'{v}.parts', f'{v}.n', 'm.start', 'm.`end`', keep)})))""")
    return per.select(*KEY, "prefix", "line", F.expr(shown).alias("ms"))


def _settled(per: DataFrame, ms: str) -> DataFrame:
    """per with new matches, computed once: a generator keeps them out of the expressions above, which go through them again and again."""
    return per.select(*KEY, "prefix", "line", F.expr(f"explode(array({ms}))").alias("ms"))


def _left_to_right() -> str:
    """ms, with the matches of terms that may overlap themselves as a search from left to right finds them."""
    cut = "concat('\\\\Q', replace(u.word_lc, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')"
    again = let(_placed(spans("lower(line)", cut)), lambda v: f"transform({let(chunks('line'), lambda p: f'filter({v}, s -> {whole_word(p, "s.start", "s.`end`")})')}, s -> named_struct('start', s.start, 'end', s.`end`, 'src', u.src, 'word_lc', u.word_lc, 'template', u.template, 'rx', u.rx, 'overlaps', true))")
    terms_of = "array_distinct(transform(filter(ms, m -> m.overlaps), m -> named_struct('src', m.src, 'word_lc', m.word_lc, 'template', m.template, 'rx', m.rx)))"
    return f"array_sort(concat(filter(ms, m -> not m.overlaps), flatten(transform({terms_of}, u -> {again}))))"


def _told_once() -> str:
    """ms without those whose span an earlier phrase or pattern with a template has."""
    begins = "transform(ms, (m, i) -> if(i > 0 and m.start = get(ms, i - 1).start and m.`end` = get(ms, i - 1).`end`, 0, i))"
    first = let(begins, lambda b: running(b, "greatest({}, {})"))
    # slice() goes through the whole array each time
    earlier = "(get(f, i) < i and exists(sequence(get(f, i), i - 1), j -> get(ms, j).src > 0 and trim(coalesce(get(ms, j).template, '')) <> ''))"
    return f"transform(array({first}), f -> filter(ms, (m, i) -> m.src < 2 or not {earlier}))[0]"


def exploded(per: DataFrame) -> DataFrame:
    """One row per match of found_lines."""
    return per.select(*KEY, F.explode("ms").alias("m")).select(*KEY, "m.*").select(*MATCH)


def find(rows: DataFrame, guard: Guard, words: DataFrame | None = None) -> DataFrame:
    """All matches of a guard in lines (file, line_num, line), less the ignored. words replaces the guard's values."""
    return exploded(found_lines(rows, guard, words))


def template_rank(template: Column) -> Column:
    return F.when(blank(template), 2).when(F.instr(template, "{") > 0, 1).otherwise(0)
