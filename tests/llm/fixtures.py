"""Rows with everything that may go wrong, beside the given documents."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"

ODD = [
    (900001, None, None, None, None),
    (900002, "", "en", "s", 0),
    (None, None, None, None, None),
    (None, "A B\tC under the MIT license", "en", "s", 1),
    (900003, "AB C\nunder the mit license", "en", "s", 1),
    (900003, "AB C\nunder the mit license", "en", "s", 1),
    (900004, "word " * 30000 + "mail me.x+y@a-b.example.org or 192.168.000.255, 1.2.3.999, +49 (30) 1234-5678 and 4111 1111-1111 1111.", "en", "s", 1),
    (900005, "a@" + "b" * 50000 + " é@x.y İ Kelvin K mit@x.y_z@q.r.s +1234 +12 34 56 78 9 1.2.3.4.5.6.7.8 Apache-License, VERSION 2 apache license version 2", "en", "s", 1),
    (900006, "x" * 200000, "en", "s", 1),
    (900007, " \t\n ", "en", "s", 1),
    (900008, "under the mit license under the mit license cc by-nc; \U0001f600 cc by nc a@b.c +123456789", "en", "s", 1),
]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {"size": F.lit("clash"), "digest": F.lit(1), "words": F.lit("w"), "uid": F.lit(7), "cell": F.lit(3), "label": F.lit(None).cast("int"), "score": F.lit(2.0), "rank": F.lit(1), "hits": F.lit(1)}
    )


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
