"""Personal data: base expressions and bootstrapped contextual extraction.

DataFrame functions only: no Python runs on the executors.

1. *Base.*  E-mail addresses, IP addresses, card numbers and phone numbers, by
   expressions and checks.  They are the seeds.
2. *Contexts.*  Tokens with a digit or an ``@`` are located with the two words
   before them: a lexical pattern.  A token that touches a base span is the seed
   of that span; another one is a candidate if it has the shape of an identifier.
3. *Graph.*  Patterns that at least ``min_support`` different instances follow,
   and the different things that follow each anywhere in the corpus: seeds,
   candidates and all other words.
4. *Rounds.*  A pattern's confidence is the share of its followers' scores in
   the number of its different followers, in thousandths; a seed counts 1000, a
   candidate the best confidence among its active patterns, any other word 0.  A
   pattern is active from ``min_confidence`` and ``min_support`` instances with a score on.
   Scores are whole numbers and maxima, so no order of rows changes them.  Rounds
   end when the active patterns stay the same, or after ``rounds``.
   Followers without a digit or an ``@`` are counted in one pass over all texts:
   triples of words pass a filter of ``FILTER`` bits, set by the hashes of the
   patterns, and are made distinct and counted before they meet the patterns.
5. *Discovery.*  Every candidate behind an active pattern becomes a span of kind
   ``context``: identifiers no expression describes, also of unseen forms.

Spans are code-point offsets, end exclusive.  Positions come from the lengths
of what lies between matches, summed in blocks of ``BLOCK`` matches, so a long
text with many matches costs little more than its length.  Both words of a
pattern lie within ``REACH`` characters before the token and hold no digit or ``@``.

Each round and the graph are written below the checkpoint folder.  Edges are
distinct before they are counted, so copies of a document do not weigh more than
one.  Rows are told apart by two 64-bit hashes of id and text, and only rows
that hold a candidate behind a pattern are joined with what was discovered.

Null text counts as empty and has no spans; every input row gives one output
row, repeated rows included.  Without seeds nothing is discovered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.llm.common import stored, table, texts

KINDS = ("email", "ip", "card", "phone")
FOUND = "context"

# The expressions, in a form that never steps back into a repeated group and
# starts only where a match can start; tests compare them with the plain ones.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
EXPRESSIONS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
#: What a text must hold for the kind's expression to be tried at all.
NEEDED = {"email": "contains({0}, '@')", "ip": r"{0} rlike r'[0-9]\.[0-9]+\.'",
          "card": r"{0} rlike r'[0-9][\x20-]?[0-9]'", "phone": "contains({0}, '+')"}

BLANK = r"\x09-\x0D\x20"
TOKEN = rf"(?<![^{BLANK}])[^{BLANK}]*?[0-9@][^{BLANK}]*+"
BEFORE = rf"(?:^|[{BLANK}])([^{BLANK}]++)[{BLANK}]++([^{BLANK}]++)[{BLANK}]++$"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
SHAPE = r"^[A-Za-z0-9][A-Za-z0-9._:/#@+-]{4,62}[A-Za-z0-9]$"

BLOCK = 256
REACH = 80
MIN_DIGITS = 3
MIN_SUPPORT = 3
MIN_CONFIDENCE = 500
ROUNDS = 6
#: Bits of the filter through which words pass on their way to the patterns, in words of 64.
FILTER = 1 << 18

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HIT = "struct<start:bigint,end:bigint,gap:string,hit:string>"


def located(df: DataFrame, text: str, expression: str, needed: str, out: str) -> DataFrame:
    """Adds ``out``: the matches of the expression with their places and, in
    ``gap``, the end of the text between the match before and this one."""
    between, steps = f"_{out}_between", f"_{out}_steps"
    # two uses of each column keep the optimizer from putting its expression into the loops below
    df = df.withColumn(between, F.expr(f"if({needed.format(text)}, split({text}, r'{expression}', -1), null)"))
    df = df.withColumn(steps, F.expr(f"""if(size({between}) > 1, zip_with(slice({between}, 1, size({between}) - 1),
      regexp_extract_all({text}, r'{expression}', 0), (g, x) -> named_struct('gap', g, 'hit', x)), null)"""))
    blocks = f"""transform(sequence(0, (size({steps}) - 1) div {BLOCK}), b -> aggregate(
      slice({steps}, cast(b * {BLOCK} + 1 as int), {BLOCK}),
      named_struct('at', 0L, 'out', cast(array() as array<{HIT}>)),
      (a, s) -> named_struct('at', a.at + char_length(s.gap) + char_length(s.hit), 'out', array_append(a.out,
        named_struct('start', a.at + char_length(s.gap), 'end', a.at + char_length(s.gap) + char_length(s.hit),
          'gap', right(s.gap, {REACH}), 'hit', s.hit)))))"""
    df = df.withColumn(f"_{out}_blocks", F.expr(blocks))
    return df.withColumn(out, F.expr(f"""coalesce(flatten(aggregate(_{out}_blocks,
      named_struct('at', 0L, 'out', cast(array() as array<array<{HIT}>>)),
      (a, b) -> named_struct('at', a.at + b.at, 'out', array_append(a.out, transform(b.out,
        x -> named_struct('start', a.at + x.start, 'end', a.at + x.end, 'gap', x.gap, 'hit', x.hit)))),
      a -> a.out)), cast(array() as array<{HIT}>))""")).drop(between, steps, f"_{out}_blocks")


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the check, every second digit from the right doubled."""
    d = f"cast(substr(reverse({digits}), i, 1) as bigint)"
    return f"""aggregate(sequence(1, length({digits})), 0L,
      (s, i) -> s + if(i % 2 = 1, {d}, (2 * {d}) div 10 + (2 * {d}) % 10)) % 10 = 0"""


def base(df: DataFrame) -> DataFrame:
    """Adds one array of (start, end, gap, hit) per kind; ``df`` has a column ``text`` without nulls."""
    for kind in KINDS:
        df = located(df, "text", EXPRESSIONS[kind], NEEDED[kind], kind)
    bare = "replace(replace(x.hit, ' ', ''), '-', '')"
    holds = {
        "ip": rf"x.hit rlike r'^{PART}\.{PART}\.{PART}\.{PART}$'",
        "card": f"length({bare}) between 13 and 19 and {luhn(bare)}",
        "phone": "length(regexp_replace(x.hit, '[^0-9]', '')) between 9 and 15",
    }
    for kind, test in holds.items():
        df = df.withColumn(kind, F.expr(f"filter({kind}, x -> {test})"))
    return df


def contexts(df: DataFrame) -> DataFrame:
    """Adds ``near``: (start, end, pattern, instance, seed, ident) of tokens behind two words."""
    df = located(df, "text", TOKEN, "{0} rlike '[0-9@]'", "near")
    core = r"regexp_extract(regexp_replace(x.hit, r'^[^A-Za-z0-9+]+', ''), r'(?s)^.*[A-Za-z0-9]', 0)"
    low = f"translate(x.gap, '{UPPER}', '{LOWER}')"
    df = df.withColumn("near", F.expr(f"""filter(transform(near, x -> named_struct('start', x.start, 'end', x.end,
      'first', regexp_extract({low}, r'{BEFORE}', 1), 'second', regexp_extract({low}, r'{BEFORE}', 2),
      'core', if(length(x.hit) <= 256, {core}, ''), 'lead', if(length(x.hit) <= 256,
        length(x.hit) - length(regexp_replace(x.hit, r'^[^A-Za-z0-9+]+', '')), 0))), x -> x.first <> '')"""))
    df = df.withColumn("_base", F.concat(*KINDS))
    df = df.withColumn("near", F.expr("""transform(near, x -> named_struct('x', x, 'seed',
      get(filter(_base, b -> b.start < x.end and b.end > x.start), 0).hit))"""))
    return df.withColumn("near", F.expr(rf"""transform(near, n -> named_struct(
      'start', n.x.start + n.x.lead, 'end', n.x.start + n.x.lead + length(n.x.core),
      'pattern', concat(n.x.first, ' ', n.x.second), 'instance', coalesce(n.seed, n.x.core), 'seed', n.seed is not null,
      'ident', n.seed is not null or (n.x.core rlike r'{SHAPE}' and regexp_count(n.x.core, '[0-9]') >= {MIN_DIGITS})))""")) \
        .drop("_base")


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, one array per kind, near) of every row, without the texts."""
    df = texts(docs, id_col, text_col)
    df = df.select("doc_id", F.xxhash64(F.lit(1), "doc_id", "text").alias("k1"),
                   F.xxhash64(F.lit(2), "text", "doc_id").alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    df = contexts(base(df))
    for kind in KINDS:
        df = df.withColumn(kind, F.expr(f"transform({kind}, x -> named_struct('start', x.start, 'end', x.end))"))
    return df.drop("text")


def graph(found: DataFrame, min_support: int) -> tuple[DataFrame, DataFrame]:
    """Edges (pattern, instance, seed) and, by pattern that ``min_support`` identifiers
    follow, the number of its different followers with a digit or an ``@``."""
    near = found.select(F.explode("near").alias("n")).select("n.*")
    edges = stored(near.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("ident").alias("ident")),
                   "pii-edges")
    of_pattern = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("followers"), F.sum(F.col("ident").cast("int")).alias("idents"))
    patterns = stored(of_pattern.where(F.col("idents") >= min_support).select("pattern", "followers"), "pii-patterns")
    return edges.where("ident").drop("ident"), patterns


def lowered(text: str) -> str:
    """SQL: A-Z in lower case; other letters stay as they are."""
    return f"if(octet_length({text}) = char_length({text}), lower({text}), translate({text}, '{UPPER}', '{LOWER}'))"


def with_words(docs: DataFrame, patterns: DataFrame, text_col: str) -> DataFrame:
    """The patterns, their followers without digit or ``@`` counted too."""
    bit = F.expr(f"pmod(xxhash64(substring_index(pattern, ' ', 1), substring_index(pattern, ' ', -1)), {FILTER})")
    masks = dict(patterns.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("at"))
                 .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))")).collect())
    mask = ",".join(f"{masks.get(i, 0)}L" if masks.get(i, 0) > -2 ** 63 else "shiftleft(1L, 63)" for i in range(FILTER // 64))
    words = docs.select(F.expr(f"split({lowered(f'`{text_col}`')}, r'[{BLANK}]+', -1)").alias("w"))
    # the outer form adds no test of its input, so texts are split once; rows it pads have no third word
    three = words.select(F.expr("""inline_outer(arrays_zip(w, slice(w, 2, greatest(size(w) - 2, 0)),
      slice(w, 3, greatest(size(w) - 2, 0))))""").alias("first", "second", "c"))
    three = three.withColumn("bit", F.expr(f"cast(pmod(xxhash64(first, second), {FILTER}) as int)")) \
        .where(f"getbit(get(array({mask}), bit div 64), bit % 64) = 1 and first <> '' and c <> '' and not c rlike '[0-9@]'")
    others = three.select("first", "second", "c").distinct().groupBy("first", "second").agg(F.count(F.lit(1)).alias("others")) \
        .select(F.concat_ws(" ", "first", "second").alias("pattern"), "others")
    sizes = patterns.join(others, "pattern", "left").select(
        "pattern", (F.col("followers") + F.coalesce("others", F.lit(0))).alias("followers"))
    return stored(sizes, "pii-followers")


def bootstrap(edges: DataFrame, sizes: DataFrame, min_support: int = MIN_SUPPORT,
              min_confidence: int = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence) of the active patterns after the last round."""
    edges = stored(edges.join(sizes.select("pattern"), "pattern", "left_semi"), "pii-graph")
    seeds = edges.where("seed").select("instance").distinct().withColumn("score", F.lit(1000).cast("long"))
    others = edges.where("not seed").join(seeds, "instance", "left_anti")
    scores, mark, active = seeds, None, None
    for _ in range(rounds):
        sums = edges.join(scores, "instance").groupBy("pattern").agg(F.sum("score").alias("sum"), F.count("score").alias("known"))
        active = stored(sums.join(sizes, "pattern").withColumn("confidence", F.expr("sum div followers"))
                        .where((F.col("confidence") >= min_confidence) & (F.col("known") >= min_support))
                        .select("pattern", "confidence"), "pii-active")
        now = active.agg(F.count(F.lit(1)), F.sum(F.xxhash64("pattern", "confidence").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        reached = others.join(active, "pattern").groupBy("instance").agg(F.max("confidence").cast("long").alias("score"))
        scores = stored(seeds.unionByName(reached), "pii-scores")
    return active


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT,
            min_confidence: int = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, email, ip, card, phone, context) of every row: arrays of (start, end) in order."""
    found = stored(read(docs, id_col, text_col), "pii-read")
    edges, patterns = graph(found, min_support)
    active = bootstrap(edges, with_words(docs, patterns, text_col), min_support, min_confidence, rounds)
    may = F.exists("near", lambda n: n["ident"] & ~n["seed"])
    near = found.where(may).select("k1", "k2", F.explode("near").alias("n")).where("n.ident and not n.seed")
    spans = near.select("k1", "k2", "n.pattern", "n.start", "n.end").join(active.select("pattern"), "pattern") \
        .groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(FOUND))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    out = ["doc_id", *KINDS, FOUND]
    with_some = found.where(may).join(spans, ["k1", "k2"], "left").withColumn(FOUND, F.coalesce(FOUND, none))
    return with_some.select(*out).unionByName(found.where(~may).withColumn(FOUND, none).select(*out))


def listed(*kinds: str) -> Column:
    return F.array_join(F.concat(*[F.expr(f"transform({k}, x -> concat_ws(':', '{k}', x.start, x.end))") for k in kinds]), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    counted = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counted, F.sha2(listed(*KINDS), 256).alias("base_sha256"),
                        listed(*KINDS, FOUND).alias("spans"))
