import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


#: Null, empty, very short and very long texts, repeated rows, odd characters.
TEXTS = [None, "", " ", "a", "The cat sat on the mat.", "The cat sat on the mat.", "don't WE'LL İstanbul été Σίσυφος ΣΑΣ 123 ½ x​y", "<|endoftext|> is text", "\n\t  \r\n two  words \n", "word " * 5000, "ßtraße \U0001f600 emoji 漢字かな"]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")
