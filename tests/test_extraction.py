"""Query text out of whole documents."""

import re

from tessera.plans.scores import extract_query_text


def test_extract_query_text_wraps_the_whole_text(spark):
    texts = ['He said "no" \\ and (so on);\n# no comment\r# nor this\u2028# nor that, ' * 3, "long words, " * 20_000, '\\"\n' * 20_000, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in extract_query_text(lambda name: docs).collect()}
    for k, t in enumerate(texts):
        if t is None:
            assert got[k]["query"] is None and got[k]["compared"] == ""
            continue
        for end, name in (("\\", "\\"), ('"', '"'), ("\n", "n"), ("\r", "r"), ("\u2028", "u2028")):
            t = t.replace(end, "\\" + name)
        query = 'select ?d where { ?d x:text "' + t + '" . }'
        spaced = re.sub(r"([{}();,])", r" \1 ", query)
        assert (got[k]["query"], got[k]["form"]) == (query, "select")
        assert got[k]["compared"] == "PREFIX x: <http://x/> " + re.sub(r"\s+", " ", spaced, flags=re.A).strip()
