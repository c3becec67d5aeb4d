"""Seeded data generators. Every one is a projection of a range, so it is made in parallel and is the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seven invented laptop models; the first is the hot one.
LAPTOP_MODELS = (("Acme", "Air"), ("Acme", "Book"), ("Borea", "Slim"), ("Borea", "Work"), ("Cirrus", "One"), ("Delta", "Go"), ("Delta", "Max"))
#: An invented vocabulary for texts.
WORDS = ("amber", "basil", "cedar", "delta", "ember", "fjord", "grove", "heron", "islet", "jetty", "knoll", "lumen", "maple", "nadir", "ochre", "pearl")


def uniform(seed: int, *salt: object) -> Column:
    """A number in [0, 1) that depends on the row's id, the seed and the salt only, not on partitions."""
    bits = F.xxhash64(F.col("id"), F.lit(seed), *[F.lit(str(s)) for s in salt])
    return F.shiftrightunsigned(bits, 11).cast("double") / F.lit(float(1 << 53))


def random_double(limit: float, seed: int, *salt) -> Column:
    return uniform(seed, "double", *salt) * limit


def random_int(low: int, high: int, seed: int, *salt) -> Column:
    """From low to high - 1."""
    return (F.floor(uniform(seed, "int", *salt) * (high - low)) + low).cast("int")


def random_long(limit: int, seed: int, *salt) -> Column:
    return F.floor(uniform(seed, "long", *salt) * limit).cast("long")


def random_string(length: int, seed: int, *salt) -> Column:
    """Letters and digits from a hash, exactly ``length``."""
    parts = [F.md5(F.concat_ws("|", F.col("id"), F.lit(seed), F.lit(i), *[F.lit(str(s)) for s in salt])) for i in range(-(-length // 32))]
    return F.substring(F.translate(F.concat(*parts), "01234567", "ghjkmnpq"), 1, length)


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def laptop_model(skew: float, seed: int) -> tuple[Column, Column]:
    """Make and model; ``skew`` is the share that goes to the first model before the even draw."""
    at = F.when(uniform(seed, "hot") < skew, 0).otherwise(random_int(0, len(LAPTOP_MODELS), seed, "model"))
    return _pick([m for m, _ in LAPTOP_MODELS], at), _pick([m for _, m in LAPTOP_MODELS], at)


def laptops(spark: SparkSession, n: int, skew: float = 0.5, seed: int = 1) -> DataFrame:
    make, model = laptop_model(skew, seed)
    speed = random_int(30, 39, seed, "speed") / F.lit(10.0)
    return spark.range(n).select(random_string(7, seed).alias("registration"), make.alias("make"), model.alias("model"), speed.alias("procSpeed"))


def laptop_offers(spark: SparkSession, n: int, skew: float = 0.5, seed: int = 2) -> DataFrame:
    make, model = laptop_model(skew, seed)
    speed, price = random_int(30, 39, seed, "speed") / F.lit(10.0), random_int(500, 2000, seed, "price").cast("double")
    return spark.range(n).select(make.alias("make"), model.alias("model"), speed.alias("procSpeed"), price.alias("salePrice"))


def metrics(spark: SparkSession, n: int, limit: float = 1_000_000, seed: int = 3) -> DataFrame:
    return spark.range(n).select(random_string(17, seed).alias("name"), random_double(limit, seed).alias("value"))


def exam_data(spark: SparkSession, students: int, attempts: int = 5, seed: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids with names, ids with e-mails, and up to ``attempts`` different scores from 0.0 to 9.9 per student."""
    name = random_string(8, seed)
    base = spark.range(students)
    tries = base.select("id", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("try"))
    bits = F.xxhash64(F.col("id"), F.col("try"), F.lit(seed))
    scores = tries.select("id", (F.pmod(bits, F.lit(100)) / F.lit(10.0)).alias("score")).distinct()
    return base.select("id", name.alias("name")), base.select("id", F.concat(name, F.lit("@example.com")).alias("email")), scores


def encounters(spark: SparkSession, people: int, n: int, skew: float = 0.5, seed: int = 5) -> DataFrame:
    person = F.when(uniform(seed, "hot") < skew, 0).otherwise(random_int(0, people, seed, "who"))
    return spark.range(n).select(F.concat(F.lit("person_"), person).alias("personId"), random_double(10_000, seed).alias("approachValue"))


def texts(spark: SparkSession, paragraphs: int, words: int = 40, senders: int | None = None, seed: int = 6, vocabulary=WORDS) -> DataFrame:
    """Paragraphs of sentences of 2 to 13 words with a comma after about a fifth of the words; ``senders`` puts ``n // `` in front."""

    def draw(k: Column, what: str) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), k, F.lit(seed), F.lit(what)), F.lit(1 << 20))

    lengths = F.transform(F.sequence(F.lit(1), F.lit(max(1, words // 7))), lambda k: (draw(k, "len") % 12 + 2).cast("int"))

    def sentence(size: Column, at: Column) -> Column:
        tokens = F.transform(
            F.sequence(F.lit(1), size),
            lambda k: F.concat(
                _pick(vocabulary, (draw(at * 100 + k, "word") % len(vocabulary)).cast("int")),
                F.when((k < size) & (draw(at * 100 + k, "comma") % 5 == 0), ",").otherwise(""),
            ),
        )
        line = F.array_join(tokens, " ")
        return F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, F.lit(2), F.length(line)), F.lit("."))

    body = F.array_join(F.transform(lengths, lambda size, at: sentence(size, at)), " ")
    if senders:
        body = F.concat(random_int(1, senders + 1, seed, "sender").cast("string"), F.lit(" // "), body)
    return spark.range(paragraphs).select(body.alias("value"))


def word_pairs(spark: SparkSession, n: int, seed: int = 7, vocabulary=WORDS) -> DataFrame:
    return spark.range(n).select(
        _pick(vocabulary, random_int(0, len(vocabulary), seed, "word")).alias("word"), random_int(0, 1000, seed, "n").cast("long").alias("n")
    )


def leaderboard(spark: SparkSession, n: int, seed: int = 8) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("position"), random_string(8, seed).alias("name"))
