"""Phrases of a table, found in texts as they stand, punctuation included.

A phrase is looked up by its words and what is between them: ``St. Paul``,
``Coca-Cola``, ``O'Neil``. White space of any kind and length counts as one
space. Marks in front of the first word or behind the last one (``Yahoo!``)
have to stand there too.

Flags by hash, of words that are phrases and of pairs of words that begin one,
drop most positions of a text; their number is bounded. What is left is tested
as a whole phrase before any offset is worked out: against the table itself,
dealt over slots so that a lookup meets one entry or two, if the table is
small; against a Bloom filter of fixed size, if it is not. The latter's hits
meet the table in a join.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.arrays import bind, empty, let, literal, positions, totals
from spanveil.functions.spans import CONTEXT_WORDS, NOT_WORD, WORD
from spanveil.operators.recognizers import CONTEXT_BOOST, CONTEXT_FLOOR
from spanveil.plans.tables import stored

# A phrase table up to this size is sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024
FLAG_BITS = (12, 24)  # there are 2 ** 12 to 2 ** 24 flags of a byte, by the number of phrases
BLOOM_BITS = 25  # the Bloom filter of whole phrases has 2 ** BLOOM_BITS bits, 4 MB
SLOTS = 1 << 20  # at most, for a table that is sent
BLANKS = r"[\s\p{Z}]+"

HIT_TYPE = (
    "struct<start:int,end:int,entity_type:string,value:string,core:string,before:array<string>,lead:string,trail:string>"
)


def _bit(word: str, bits: int) -> str:
    return f"cast(pmod(xxhash64({word}), {1 << bits}) AS int)"


def _is_set(bitmap: str, bit: str) -> str:
    return f"shiftright(get({bitmap}, shiftright({bit}, 5)), {bit} % 32) & 1 = 1"


def _other(word: str) -> str:
    """A second hash; the marker keeps it apart from the first."""
    return f"concat(chr(1), {word})"


CHUNK = 1024


def _dense(rows: DataFrame, size: int, filler: str) -> Column:
    """Rows ``(slot, held)`` as one array of ``size`` elements, as a scalar subquery; put together by chunks.

    Up to 2 ** 20 elements are the work of one task, without a shuffle.
    """
    spark = rows.sparkSession
    if size <= 1 << 20:
        ids, rows = spark.range(0, size, 1, 1), rows.coalesce(1)
    else:
        ids = spark.range(size)
    slots = ids.join(rows, F.col("id") == F.col("slot"), "left")
    inside = F.sort_array(F.collect_list(F.struct("id", F.coalesce("held", F.expr(filler)).alias("held"))))["held"]
    chunks = slots.groupBy(F.floor(F.col("id") / F.lit(CHUNK)).alias("chunk")).agg(inside.alias("part"))
    return chunks.agg(F.flatten(F.sort_array(F.collect_list(F.struct("chunk", "part")))["part"]).alias("held")).scalar()


def bitmap_of(table: DataFrame, words: Iterable[str], bits: int) -> Column:
    """A bitmap of the hashes of some SQL expressions over all rows, as a scalar subquery of fixed size."""
    bit = F.explode(F.expr(f"array({', '.join(_bit(w, bits) for w in words)})")).alias("bit")
    rows = table.select(bit).select(F.shiftright("bit", 5).alias("slot"), F.expr("shiftleft(1, bit % 32)").alias("one"))
    return _dense(rows.groupBy("slot").agg(F.bit_or("one").alias("held")), (1 << bits) // 32, "0")


def _flag(*words: str, bits: int) -> str:
    return f"cast(pmod(xxhash64({', '.join(words)}), {1 << bits}) AS int)"


def flags_of(table: DataFrame, bits: int) -> Column:
    """Flags of single words that are phrases, and of the first two words of longer ones with what is between, as a scalar subquery."""
    words = table.withColumns({"w": F.regexp_extract_all("core", F.lit(f"{WORD}+"), F.lit(0)), "g": F.split("core", f"{WORD}+", -1)})
    words = words.coalesce(1) if bits <= 20 else words
    slot = F.when(F.col("n") == 1, F.expr(_flag("w[0]", bits=bits))).otherwise(F.expr(_flag("w[0]", "g[1]", "w[1]", bits=bits)))
    return _dense(words.select(slot.alias("slot")).distinct().withColumn("held", F.expr("1Y")), 1 << bits, "0Y")


@dataclass(frozen=True, eq=False)
class PhraseTable:
    """A table ``phrase, entity_type`` as a recognizer.

    ``score`` is that of every hit, raised where one of ``context`` is among
    the words before. ``languages`` None means any. Phrases without a letter
    or digit, NULL phrases and NULL types are left out. The table is put in
    order and stored once, when it is first used.
    """

    table: DataFrame = field(repr=False)
    name: str = "phrases"
    score: float = 0.85
    ignore_case: bool = False
    context: tuple[str, ...] = ()
    languages: tuple[str, ...] | None = None
    broadcast_bytes: int = BROADCAST_BYTES

    def __post_init__(self):
        if not 0 <= float(self.score) <= 1:
            raise ValueError(f"phrase table {self.name!r}: score must be between 0 and 1")
        missing = {"phrase", "entity_type"} - set(self.table.columns)
        if missing:
            raise ValueError(f"phrase table {self.name!r} lacks {sorted(missing)}")
        object.__setattr__(self, "context", tuple(w.lower() for w in self.context))

    @property
    def best_score(self) -> float:
        return round(min(1.0, max(self.score + CONTEXT_BOOST, CONTEXT_FLOOR)), 6) if self.context else float(self.score)

    @cached_property
    def rows(self) -> DataFrame:
        """``core, lead, trail, entity_type, n`` of the distinct phrases, stored."""
        fold = F.lower if self.ignore_case else (lambda c: c)
        text = F.regexp_replace(fold(F.col("phrase").cast("string")), BLANKS, " ")
        text = F.trim(text)
        split = self.table.select(
            F.regexp_extract(text, rf"(?s){WORD}(?:.*{WORD})?", 0).alias("core"),
            F.regexp_extract(text, rf"^{NOT_WORD}*", 0).alias("lead"),
            F.regexp_extract(text, rf"{NOT_WORD}*$", 0).alias("trail"),
            F.col("entity_type").cast("string").alias("entity_type"),
        )
        kept = split.where("core <> '' AND entity_type IS NOT NULL").distinct()
        return stored(kept.withColumn("n", F.size(F.regexp_extract_all("core", F.lit(f"{WORD}+"), F.lit(0)))), "phrases")

    @cached_property
    def size(self) -> dict:
        """Measured: bytes, rows, the lengths in words and the entity types that occur."""
        text = sum(F.octet_length(c) for c in ("core", "lead", "trail", "entity_type"))
        got = self.rows.agg(
            F.coalesce(F.sum(text + F.lit(64)), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows"),
            F.collect_set("n").alias("lengths"), F.collect_set("entity_type").alias("types"),
        )
        return got.first().asDict()

    @property
    def small(self) -> bool:
        return self.size["bytes"] <= self.broadcast_bytes

    def wanted(self, entities: Iterable[str] | None) -> PhraseTable:
        """The same with phrases of some entity types only."""
        if entities is None:
            return self
        upper = [e.upper() for e in entities]
        kept = self.table.where(F.upper("entity_type").isin(upper))
        return PhraseTable(kept, self.name, self.score, self.ignore_case, self.context, self.languages, self.broadcast_bytes)


def add_hits(df: DataFrame, text: Column, table: PhraseTable, out_col: str) -> DataFrame:
    """Add the hits of a phrase table in a text, as ``array<HIT_TYPE>``.

    Of a small table they are exact. Of a large one they are runs of words that
    may be phrases; :func:`joined_hits` tells.

    What is looked up stands in columns for the analyzer's sake alone: each is
    used once, so that the optimizer puts the subquery's result in its place
    and no row ever holds a copy. Explode the hits in a step of its own.
    """
    size = table.size
    if not size["rows"]:
        return df.withColumn(out_col, empty(HIT_TYPE))
    bits = min(max(FLAG_BITS[0], int(size["rows"]).bit_length() + 6), FLAG_BITS[1])
    first = flags_of(table.rows, bits)
    if table.small:
        count = 1
        while count < min(size["rows"], SLOTS):
            count *= 2
        slot = F.pmod(F.xxhash64("core"), F.lit(count)).cast("int").alias("slot")
        entry = F.struct("core", "lead", "trail", "entity_type")
        known = _dense(
            table.rows.coalesce(1).groupBy(slot).agg(F.collect_list(entry).alias("held")), count,
            "cast(array() AS array<struct<core:string,lead:string,trail:string,entity_type:string>>)",
        )
        here = f"filter(get(v.known, cast(pmod(xxhash64(_key), {count}) AS int)), _p -> _p.core = _key)"
    else:
        known = bitmap_of(table.rows, ["core", _other("core")], BLOOM_BITS)
        both = " AND ".join(_is_set("v.known", _bit(x, BLOOM_BITS)) for x in ("_key", _other("_key")))
        one = "named_struct('core', _key, 'lead', '', 'trail', '', 'entity_type', '')"
        here = f"CASE WHEN {both} THEN array({one}) ELSE slice(array({one}), 1, 0) END"

    fold = "lower({})" if table.ignore_case else "{}"
    word = lambda at: fold.format(f"get(_w, {at})")
    gap = lambda at: fold.format(f"get(_g, {at})")
    # what is between words, its white space as one space
    spaced = f"transform(_g, _x -> if(_x = ' ', _x, regexp_replace({fold.format('_x')}, r'{BLANKS}', ' ')))"
    key = f"aggregate({positions('1', '_n - 1')}, {word('_k')}, (_a, _i) -> concat(_a, get(_s, _k + _i), {word('_k + _i')}))"
    lengths = ", ".join(map(str, sorted(size["lengths"])))
    # (position, words, phrase) of each phrase that is there with its marks
    marks = f"endswith({gap('_k')}, _p.lead) AND startswith({gap('_k + _n')}, _p.trail)"
    entries = f"transform(filter({here}, _p -> {marks}), _p -> named_struct('k', _k, 'n', _n, 'p', _p))"
    of_length = f"transform(filter(array({lengths}), _n -> _k + _n <= size(_w)), _n -> {let(key, '_key', entries)})"
    tests = [_flag(word("_k"), bits=bits)] * (min(size["lengths"]) == 1)
    tests += [_flag(word("_k"), "get(_s, _k + 1)", word("_k + 1"), bits=bits)] * (max(size["lengths"]) > 1)
    set_ = " OR ".join(f"get(v.first, {t}) = 1Y" for t in tests)
    begins = f"filter({positions('0', 'size(_w) - 1')}, _k -> {set_})"
    found = f"flatten(flatten(transform(_begins, _k -> {of_length})))"

    raw = (
        "array_join(transform(sequence(0, _h.n - 1), _i -> concat(if(_i = 0, '', get(_g, _h.k + _i)), get(_w, _h.k + _i))), '')"
    )
    before = "transform(slice(_w, greatest(_h.k - {0}, 0) + 1, least(_h.k, {0})), _x -> lower(_x))".format(CONTEXT_WORDS)

    def placed(end_at) -> str:
        fields = {
            "start": f"{end_at('_h.k')} - length(get(_w, _h.k)) - length(_h.p.lead)",
            "end": f"{end_at('_h.k + _h.n - 1')} + length(_h.p.trail)",
            "entity_type": "_h.p.entity_type",
            "value": f"concat(right(get(_g, _h.k), length(_h.p.lead)), {raw}, left(get(_g, _h.k + _h.n), length(_h.p.trail)))",
            "core": "_h.p.core",
            "before": before if table.context else "cast(NULL AS array<string>)",
            "lead": "cast(NULL AS string)" if table.small else gap("_h.k"),
            "trail": "cast(NULL AS string)" if table.small else gap("_h.k + _h.n"),
        }
        return f"transform(_hits, _h -> named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {x}' for k, x in fields.items())}))"

    advance = "transform(_w, (_x, _i) -> length(_x) + length(get(_g, _i)))"
    # offsets are running totals over all words: only where there are hits
    nothing = f"cast(array() AS array<{HIT_TYPE}>)"
    body = let(found, "_hits", f"CASE WHEN size(_hits) = 0 THEN {nothing} ELSE {totals(advance, placed)} END")
    words = f"r'{WORD}+'"
    body = let(begins, "_begins", f"CASE WHEN size(_begins) = 0 THEN {nothing} ELSE {body} END")
    body = let(f"split(v.text, {words}, -1)", "_g", let(spaced, "_s", body))
    body = let(f"regexp_extract_all(v.text, {words}, 0)", "_w", body)
    names = {n: free_name(df, f"_{n}") for n in ("first", "known")}
    given = F.struct(text.alias("text"), *[F.col(c).alias(n) for n, c in names.items()])
    held = df.withColumns({names["first"]: first, names["known"]: known})
    return held.withColumn(out_col, bind(given, body)).drop(*names.values())


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def hit_rows(df: DataFrame, id_col: str, text_col: str, table: PhraseTable) -> DataFrame:
    """Rows ``<id, HIT_TYPE>`` of :func:`add_hits`."""
    name = free_name(df, "_hits")
    found = add_hits(df.select(id_col, text_col), F.col(text_col), table, name).select(id_col, name)
    return found.select(id_col, F.explode_outer(name).alias("_h")).where(F.col("_h").isNotNull()).select(id_col, "_h.*")


def phrase_candidates(hits: Column, table: PhraseTable, kind: str) -> Column:
    """Hits as candidates of ``analyze``."""
    raised = "false"
    if table.context:
        raised = f"arrays_overlap(coalesce(_h.before, array('')), array({', '.join(literal(w) for w in table.context)}))"
    score = f"if({raised}, {table.best_score}D, {float(table.score)}D)"
    made = (
        "named_struct('start', _h.start, 'end', _h.end, 'entity_type', _h.entity_type, "
        f"'minus_score', -({score}), 'recognizer', {literal(table.name)}, 'pattern', 'phrase', "
        f"'base_score', {float(table.score)}D, 'value', _h.value)"
    )
    return bind(hits, f"CASE WHEN size(v) > 0 THEN transform(v, _h -> {made}) ELSE cast(array() AS array<{kind}>) END")


HOT = 100_000  # rows of one key that a join brings together at most


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """An inner join of stored rows with a table on ``key``, hot keys dealt over as many parts as they need.

    Keys of more than ``HOT`` rows are counted first (added up on the map
    side); there are at most as many as rows over ``HOT``. Rows of such a key
    are dealt by ``by``, and the table's rows of it are repeated for each part.
    """
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT)
    hot = stored(counted.select(key, F.ceil(F.col("_n") / F.lit(HOT)).cast("int").alias("_parts")), "hot-keys")
    n = hot.count()
    if not n:
        return rows.join(table, key)
    sent = F.broadcast(hot) if n <= 100_000 else hot
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_parts"))).cast("int")
    left = rows.join(sent, key, "left").withColumn("_part", part).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    right = table.join(sent, key, "left").withColumn("_part", copies).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def joined_hits(df: DataFrame, id_col: str, text_col: str, table: PhraseTable) -> DataFrame:
    """Rows ``<id, start, end, entity_type, value, before>`` of a large table's phrases.

    The runs of words that pass the Bloom filter are stored without the texts
    and meet the table in a join.
    """
    runs = stored(hit_rows(df, id_col, text_col, table).drop("entity_type"), "phrase-runs")
    names = {"lead": "_lead", "trail": "_trail"}
    joined = spread_join(runs, table.rows.drop("n").withColumnsRenamed(names), "core", id_col)
    there = joined.where(F.endswith("lead", "_lead") & F.startswith("trail", "_trail"))
    return there.select(
        id_col, (F.col("start") - F.length("_lead")).alias("start"), (F.col("end") + F.length("_trail")).alias("end"), "entity_type",
        F.expr("concat(right(lead, length(_lead)), value, left(trail, length(_trail)))").alias("value"), "before",
    )
