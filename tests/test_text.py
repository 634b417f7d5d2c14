from pyspark.sql import functions as F

from tiltmeter.config import DEFAULT_SYMBOL, TAG_SYMBOLS, TOPICS
from tiltmeter.functions import text


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn("v").alias("r")).first().r


def test_normalize_text(spark):
    assert one(spark, None, text.normalize_text) == ""
    assert one(spark, "  a\t\n b  c \x1f ", text.normalize_text) == "a b c"


def test_parse_tags_forms(spark):
    cases = {
        "['a', \"b\"]": ["a", "b"], "a, b": ["a", "b"], '"a"': ["a"], "": [], None: [], "  ": [],
        "('x',)": ["x"], "[]": [], "['a', 12]": ["a", "12"], "[a, b]": ["[a", "b]"], "['it\\'s']": ["it's"],
        "a,, b ,": ["a", "b"], "12": [], "['', ' x ']": ["x"], "#Bitcoin": ["#Bitcoin"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.parse_tags("v").alias("r"))
    assert {row.v: row.r for row in df.collect()} == cases


def test_parse_tags_long_field(spark):
    field = "[" + ", ".join(f"'tag{i}'" for i in range(5000)) + "]"
    assert len(one(spark, field, text.parse_tags)) == 5000


def test_detect_topics(spark):
    rows = [
        (["#BTC"], "nothing"), ([], "Ethereum and Bitcoin"), ([], "subtle ethical ideas"), ([], "#eth $btc"),
        (["crypto"], "bitcoins"), ([], "été btcé"),
    ]
    df = spark.createDataFrame(rows, "tags array<string>, text string")
    got = [r[0] for r in df.select(text.detect_topics(F.col("tags"), F.col("text"), TOPICS)).collect()]
    assert got == [["BTC"], ["BTC", "ETH"], [], ["BTC", "ETH"], [], []]


def test_tag_symbol(spark):
    rows = [(["x", " Sol ", "btc"],), (["unknown"],), ([],)]
    df = spark.createDataFrame(rows, "tags array<string>")
    got = [r[0] for r in df.select(text.tag_symbol(F.col("tags"), TAG_SYMBOLS, DEFAULT_SYMBOL)).collect()]
    assert got == ["SOL", "CRYPTO", "CRYPTO"]


def test_answers(spark):
    cases = {
        "buy or sell? Answer: SELL": "SELL", "I buy, then sell": "BUY", "hold": "HOLD", "": "HOLD", None: "HOLD",
        "Answer: buy Answer: nothing": "HOLD",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.answer_action("v").alias("r"))
    assert {row.v: row.r for row in df.collect()} == cases
    assert one(spark, "not Negative, POSITIVE", text.answer_sentiment) == "positive"
    assert one(spark, "meh", text.answer_sentiment) == "neutral"
