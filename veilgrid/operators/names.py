"""Name classification: identifiers, keys, fields and lines to data types.

Each distinct name is tokenized once, met with the patterns by an equality of its
tokens with a pattern's first, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words around a data word that do not change its meaning.
NEUTRAL = (
    "user users customer client contact primary secondary alt alternate new old raw input value val str string text current cur my your owner member account person "
    "profile home work personal private billing shipping recipient sender receiver from to cc bcc reply param arg req resp dto data info list arr array the a an of "
    "plain clear cleartext plaintext full original orig unmasked real normalized trimmed formatted local entered typed confirm confirmation backup emergency patient "
    "employee staff driver rider buyer seller merchant applicant guest subscriber"
).split()
#: Last words that make a name a thing about the data.
NEGATIVE_HEADS = (
    "service svc client validator validation verifier formatter parser util utils helper helpers provider manager repository repo dao controller handler adapter holder "
    "view button btn layout label hint field template subject body pattern regex re format mask config cfg settings setting option options opts enabled disabled count "
    "cnt len length size max min limit type kind status state error err errors exception message msg key keys column col attr attribute event events screen page "
    "fragment activity dialog modal component widget icon url link verified verification confirmed sent clicked entered changed submitted tapped opened updated failed "
    "success succeeded required visible visibility permission permissions code otp pin prefix suffix extension ext country domain host server port enum annotation token "
    "sender notification notifications campaign queue topic job worker task id ids mode flag flags style color font index idx offset schema spec test tests mock stub "
    "fake factory builder listener callback cb fn func regexp matcher checker check rule rules policy api endpoint route path dir file filename name names class types "
    "table placeholder request requests picker selector input_type keyboard badge chip tab"
).split()
#: First words that make a name a flag or an action.
NEGATIVE_PREFIXES = (
    "is has should can did will was enable enabled show hide allow need needs require requires use uses validate verify check format parse on handle update max min num "
    "count total len no invalid valid missing empty default send resend get set fetch load save delete remove reset edit change must supports support with without "
    "include exclude ask prompt select"
).split()
NEGATIVE_ANYWHERE = "regex regexp pattern placeholder template hint label validator formatter enum annotation".split()
#: Words that tell of a transform, by the transform.
TRANSFORM_WORDS = {
    "masked": "masked obfuscated truncated partial last4", "hashed": "hashed hash digest", "sha256": "sha256", "sha1": "sha1", "md5": "md5", "sha512": "sha512",
    "encrypted": "encrypted enc cipher ciphertext sealed", "redacted": "redacted scrubbed", "tokenized": "tokenized", "anonymized": "anonymized anonymised",
    "pseudonymized": "pseudonymized pseudonymised",
}
SANITIZER_WORDS = {
    "masked": "mask masked obfuscate truncate", "redacted": "redact redacted scrub", "anonymized": "anonymize anonymise anonymized",
    "pseudonymized": "pseudonymize pseudonymise pseudonymized", "hashed": "hash hashed digest bcrypt argon2 scrypt", "sha256": "sha256", "sha512": "sha512",
    "sha1": "sha1", "md5": "md5", "hmac": "hmac", "encrypted": "encrypt encrypted seal sealed", "tokenized": "tokenized tokenize",
}
NOT_SANITIZERS = "map set table code tag tags bucket ring key keys mapof setof equals compare verify check valid is unmask decrypt decrypted unseal".split()
COMPACT_STOP = "microphone headphone earphone smartphone iphone xylophone saxophone megaphone phoneme phonetic gramophone telephony".split()
PERSON_ENTITIES = (
    "user customer person member employee patient account profile contact applicant student teacher driver passenger guest subscriber buyer seller owner cardholder "
    "holder recipient"
).split()
#: Confidences.
EXACT, NEUTRAL_CONTEXT, OTHER_CONTEXT, COMPACT, WEAK = 0.9, 0.85, 0.72, 0.55, 0.25
MAX_TOKENS, MIN_COMPACT = 8, 5


def tokens(name: Column) -> Column:
    """Lower-case words of an identifier, split at case, digit and sign borders."""
    for border in ("(?<=\\p{Ll})(?=\\p{Lu})", "(?<=\\p{Lu})(?=\\p{Lu}\\p{Ll})", "(?<=\\p{Nd})(?=\\p{L})|(?<=\\p{L})(?=\\p{Nd})", "[^\\p{L}\\p{Nd}]+"):
        name = F.regexp_replace(name, border, " ")
    return F.filter(F.split(F.lower(name), " "), lambda t: t != "")


def digit_joins(toks: Column) -> Column:
    """The tokens, then each word joined with the number after it."""
    number = lambda t: F.regexp(t, F.lit("^[0-9]+$"))
    pairs = F.zip_with(F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))), F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))), lambda a, b: F.when(number(b) & ~number(a), F.concat(a, b)))
    return F.concat(toks, F.filter(pairs, lambda p: p.isNotNull()))


def _mapped(toks: Column, words: dict[str, str], last: bool) -> Column:
    pairs = [(w, t) for t, held in words.items() for w in held.split()]
    table = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    found = F.filter(F.transform(toks, lambda t: F.try_element_at(table, t)), lambda t: t.isNotNull())
    return F.try_element_at(found, F.lit(-1 if last else 1))


def sanitizer(name: Column) -> Column:
    """The transform that a function's name tells of, or null."""
    toks = tokens(name)
    return F.when(~F.arrays_overlap(toks, F.array(*map(F.lit, NOT_SANITIZERS))), _mapped(digit_joins(toks), SANITIZER_WORDS, False))


def patterns(types: DataFrame) -> DataFrame:
    """A row per pattern: ord, data_type, toks, n, joined, weak, exclude."""
    rows = types.withColumn("p", F.explode(F.concat(F.transform("patterns", lambda p: F.struct(p.alias("text"), F.lit(False).alias("weak"))), F.transform("weak", lambda p: F.struct(p.alias("text"), F.lit(True).alias("weak"))))))
    rows = rows.select("ord", "data_type", F.split("p.text", " ").alias("toks"), "p.weak", "exclude")
    return rows.withColumns({"n": F.size("toks"), "joined": F.array_join("toks", "")})


def _vocabulary(types: DataFrame) -> list[str]:
    return sorted({t for r in types.select("patterns", "weak").collect() for p in [*r.patterns, *r.weak] for t in p.split(" ")})


def singular(toks: Column, vocabulary: list[str]) -> Column:
    known = F.array(*map(F.lit, vocabulary))
    cut = lambda t, n: F.substr(t, F.lit(1), F.length(t) - n)
    one = lambda t: (
        F.when((F.length(t) > 4) & F.endswith(t, F.lit("es")) & F.array_contains(known, cut(t, 2)), cut(t, 2))
        .when((F.length(t) > 3) & F.endswith(t, F.lit("s")) & F.array_contains(known, cut(t, 1)), cut(t, 1))
        .otherwise(t)
    )
    return F.transform(toks, one)


def _words(values) -> Column:
    return F.array(*map(F.lit, values))


def _met(toks: DataFrame, pats: DataFrame, by: list[str]) -> DataFrame:
    """First place of every pattern in every token list."""
    at = toks.select(*by, "toks", F.posexplode("toks").alias("at", "tok"))
    pats = pats.withColumnRenamed("toks", "ptoks").withColumn("tok", F.col("ptoks")[0])
    met = at.join(F.broadcast(pats), "tok").filter(F.slice("toks", F.col("at") + 1, F.col("n")) == F.col("ptoks"))
    return met.groupBy(*by, "ord", "data_type", "ptoks", "weak", "n", "joined").agg(F.min("at").alias("at"), F.first("toks").alias("toks"), F.first("exclude").alias("exclude"))


def classify(df: DataFrame, name_col: str, types: DataFrame) -> DataFrame:
    """Adds ``named``: struct(data_type, confidence, transform, pattern), null where a name means none."""
    vocabulary, pats = _vocabulary(types), patterns(types)
    transforms = sorted(w for held in TRANSFORM_WORDS.values() for w in held.split())
    toks = df.select(F.col(name_col).alias("name_")).distinct().withColumn("raw", tokens(F.col("name_"))).filter(F.size("raw").between(1, MAX_TOKENS))
    toks = toks.withColumn("toks", singular(F.col("raw"), vocabulary)).filter(~F.arrays_overlap("toks", _words(NEGATIVE_ANYWHERE)))
    toks = toks.select("name_", "toks", _mapped(digit_joins(F.col("toks")), TRANSFORM_WORDS, True).alias("transform"))
    met = _met(toks, pats, ["name_"]).join(toks.select("name_", "transform"), "name_")
    outside = F.concat(F.slice("toks", 1, F.col("at")), F.slice("toks", F.col("at") + F.col("n") + 1, F.size("toks")))
    last, is_transform = F.element_at("toks", -1), lambda t: t.isin(transforms)
    head = (F.size("toks") - 1 >= F.col("at") + F.col("n")) & last.isin(NEGATIVE_HEADS) & ~(F.col("transform").isNotNull() & is_transform(last))
    prefix = (F.col("at") > 0) & F.col("toks")[0].isin(NEGATIVE_PREFIXES)
    quiet = F.forall(outside, lambda t: t.isin(NEUTRAL) | is_transform(t) | F.regexp(t, F.lit("^[0-9]+$")))
    score = F.when(F.size(outside) == 0, EXACT).when(quiet, NEUTRAL_CONTEXT).otherwise(OTHER_CONTEXT)
    exact = met.filter(~F.arrays_overlap(outside, "exclude") & ~head & ~prefix).select("name_", "ord", "data_type", "n", F.array_join("ptoks", " ").alias("pattern"), (score - F.when(F.col("weak"), WEAK).otherwise(0.0)).alias("confidence"))
    tight = F.broadcast(pats.filter(~F.col("weak") & (F.length("joined") >= MIN_COMPACT)).withColumnRenamed("toks", "ptoks"))
    stop = lambda t: F.exists(_words(COMPACT_STOP), lambda s: F.contains(t, s))
    holds = F.exists("toks", lambda t: (F.length(t) > F.length("joined")) & F.contains(t, F.col("joined")) & ~stop(t))
    long = toks.filter(F.exists("toks", lambda t: F.length(t) > MIN_COMPACT))
    compact = long.join(tight, holds & ~F.arrays_overlap("toks", "exclude")).join(met.select("name_", "ptoks"), ["name_", "ptoks"], "left_anti")
    compact = compact.select("name_", "ord", "data_type", "n", F.array_join("ptoks", " ").alias("pattern"), F.lit(COMPACT).alias("confidence"))
    order = Window.partitionBy("name_").orderBy(F.col("confidence").desc(), F.col("n").desc(), "ord", "pattern")
    best = exact.unionByName(compact).withColumn("place", F.row_number().over(order)).filter("place = 1").join(toks.select("name_", "transform"), "name_")
    best = best.select("name_", F.struct("data_type", "confidence", "transform", "pattern").alias("named"))
    return df.join(best, df[name_col].eqNullSafe(best["name_"]), "left").drop("name_")


def less(named: Column, by: float) -> Column:
    return F.when(named.isNotNull(), named.withField("confidence", named["confidence"] - by))


def classify_keys(df: DataFrame, key_col: str, types: DataFrame) -> DataFrame:
    """String keys: free text is rejected, keys count a little less than names."""
    out = classify(df, key_col, types)
    fits = F.col(key_col).rlike("^[A-Za-z_\\p{L}][\\p{L}A-Za-z0-9_.\\-]{0,47}$")
    return out.withColumn("named", F.when(fits, less(F.col("named"), 0.1)))


def classify_getters(df: DataFrame, name_col: str, types: DataFrame) -> DataFrame:
    """Accessors such as getEmail, by the name they give access to."""
    base = df.withColumn("base_", F.regexp_replace(name_col, "^[gG]et(?=[A-Z])", ""))
    return classify(base, "base_", types).withColumn("named", less(F.col("named"), 0.05)).drop("base_")


def last_segment(name: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(name, "^[*\\[\\]&]+", ""), "([^./]*)$", 1)


def classify_fields(df: DataFrame, owner_col: str, field_col: str, types: DataFrame) -> DataFrame:
    """Fields with their owner as context: the bare name of a person, the holder of a card."""
    out = classify(df, field_col, types)
    owner = tokens(last_segment(F.coalesce(owner_col, F.lit(""))))
    one = singular(owner, PERSON_ENTITIES)
    named = F.col("named")
    card = F.arrays_overlap(owner, _words(["card", "cardholder"]))
    refined = F.when((named["data_type"] == "person_name") & card, named.withField("data_type", F.lit("cardholder_name"))).otherwise(named)
    holder_at, person_at = F.array_position(owner, "cardholder"), F.array_position(F.transform(one, lambda t: t.isin(PERSON_ENTITIES)), True)
    entity = F.when((holder_at > 0) & (holder_at <= person_at), "cardholder_name").when(person_at > 0, "person_name")
    bare = F.struct(entity.alias("data_type"), F.lit(0.6).alias("confidence"), F.lit(None).cast("string").alias("transform"), F.lit("entity name").alias("pattern"))
    is_name = (F.size(tokens(F.col(field_col))) == 1) & (tokens(F.col(field_col))[0] == "name")
    return out.withColumn("named", F.when(named.isNotNull(), refined).when(is_name & entity.isNotNull(), bare))


def with_context(df: DataFrame, line_col: str, types: DataFrame) -> DataFrame:
    """Adds ``context``: the data types that a line's text mentions."""
    vocabulary = _vocabulary(types)
    pats = patterns(types).filter("NOT (weak AND n = 1 AND length(joined) < 3)")
    toks = df.select(F.col(line_col).alias("line_")).distinct().withColumn("toks", singular(tokens(F.col("line_")), vocabulary))
    said = _met(toks, pats, ["line_"]).groupBy("line_").agg(F.array_sort(F.collect_set("data_type")).alias("context"))
    out = df.join(said, df[line_col] == said["line_"], "left").drop("line_")
    return out.withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
