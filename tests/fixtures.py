"""Small invented frames with the edge cases that the operators must meet."""

BANDS = [(None, 1, "Quiet Harbor", 1971), ("Lund", 2, "Paper Lanterns", 1984), ("Oslo", 3, "Granite Choir", 1990), ("Riga", 4, "No Players Yet", 2001)]
PLAYERS = [(1, [10, 11], 1, "Ada"), (2, [11], 2, "Bo"), (1, [13], 3, "Cy"), (99, [12, 12], 4, "Di"), (None, None, 5, "El")]
GUITARS = [("electric", 10, "Fenn", "Arrow"), ("acoustic", 11, "Fenn", "Bough"), ("electric", 12, "Marl", "Comet"), ("bass", 13, "Marl", "Drum"), ("bass", 14, "Olde", "Nobody")]


def bands(spark):
    return spark.createDataFrame(BANDS, "hometown STRING, id BIGINT, name STRING, year BIGINT")


def players(spark):
    return spark.createDataFrame(PLAYERS, "band BIGINT, guitars ARRAY<BIGINT>, id BIGINT, name STRING")


def guitars(spark):
    return spark.createDataFrame(GUITARS, "guitarType STRING, id BIGINT, make STRING, model STRING")
