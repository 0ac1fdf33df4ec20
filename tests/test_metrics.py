"""The metric catalogue on items whose scores are known."""

from tessera.operators.metrics import metric_long
from tessera.operators.summary import metric_summary

EXEC = "struct<status:string,result_type:string,boolean:boolean,bindings:array<map<string,struct<type:string,value:string,datatype:string,lang:string>>>>"
SCHEMA = f"item_id string, pred_query string, gold_query string, pred {EXEC}, gold {EXEC}, evaluated boolean, allowed array<string>, placeholder_mode boolean"
XSD = "http://www.w3.org/2001/XMLSchema#"


def select(*values, name="x", datatype=None):
    return ("ok", "select", None, [{name: ("literal", v, datatype, None)} for v in values])


def test_records(spark):
    q = "SELECT ?x WHERE { ?x orkgp:P1 ?y . ?y a orkgc:C1 . }"
    rows = [
        ("same", q, q, select("a", "b"), select("b", "a", "a"), True, ["orkgp:P1", "orkgc:C1"], False),
        ("part", q.replace("P1", "P2"), q, select("a", "b", "c"), select("b", "c", "d", "e"), True, ["orkgp:P1"], False),
        ("number", q, q, select("1.50", datatype=XSD + "float"), select("1.5", datatype=XSD + "decimal"), True, None, False),
        ("names", q, q, select("a", name="u"), select("a", name="v"), True, None, False),
        ("kinds", "ASK { ?x orkgp:P1 pgmr:z }", q, ("ok", "ask", True, None), select("a"), True, None, True),
        ("none", None, q, None, select("a"), True, None, False),
        ("error", q, q, ("error", None, None, None), select("a"), True, None, False),
        ("empty", q, q, select(), select(), True, None, False),
    ]
    long = metric_long(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {(r["item_id"], r["metric"]): r for r in long.collect()}
    assert len(got) == len(rows) * 26
    assert {got[i, f"pgmr_rouge{k}_f1"]["reason"] for i, *_ in rows for k in "12L"} == {"prediction_query_missing"}
    value = lambda i, m: got[i, m]["value"]
    prf = lambda i, m="answer_precision_recall_f1": tuple(got[i, m][k] for k in ("precision", "recall", "f1"))
    assert value("same", "answer_exact_match") == 1 and prf("same") == (1, 1, 1) and value("same", "query_bleu") == 1 and value("same", "uri_hallucination") == 0
    assert prf("part") == (0.6667, 0.5, 0.5714) and value("part", "answer_exact_match") == 0 and value("part", "uri_hallucination") == 1
    assert prf("part", "kg_ref_match") == (0.5, 0.5, 0.5) and prf("part", "class_ref_match") == (1, 1, 1) and prf("part", "sparql_structure_match") == (0.5, 0.5, 0.5)
    assert value("number", "answer_exact_match") == 1 and value("number", "answer_cell_value_precision_recall_f1") == 0
    assert value("names", "answer_exact_match") == 0 and value("names", "answer_value_exact_match") == 1
    assert value("kinds", "answer_exact_match") == 0 and got["kinds", "answer_exact_match"]["comparable"] and value("kinds", "pgmr_unmapped_placeholders") == 1
    assert got["none", "answer_exact_match"]["reason"] == "prediction_missing" and got["none", "kg_ref_match"]["reason"] == "prediction_query_missing"
    assert got["error", "answer_exact_match"]["reason"] == "prediction_error" and not got["error", "answer_exact_match"]["comparable"]
    assert prf("empty") == (1, 1, 1) and got["same", "uri_hallucination"]["reason"] is None and got["number", "uri_hallucination"]["reason"] == "allowed_refs_missing"
    label = {i: got[i, "primary_error_category"]["reason"] for i, *_ in rows}
    assert label == {"same": "success", "part": "answer_mismatch", "number": "success", "names": "answer_mismatch", "kinds": "answer_mismatch", "none": "extraction_failure", "error": "prediction_execution_error", "empty": "success"}
    means = {r["metric"]: r for r in metric_summary(long.where("metric <> 'primary_error_category'")).collect()}
    assert means["query_extracted"]["success_count"] == 7 and means["query_extracted"]["failure_count"] == 1
    assert all(r["value"] is None or 0 <= r["value"] <= 1 for r in got.values())


def test_rouge_of_placeholder_queries(spark):
    q, p = "SELECT ?x WHERE { ?x orkgp:P1 ?y }", "SELECT ?x WHERE { ?x pgmr:has_part ?y }"
    rows = [("a", q, q, None, None, True, None, True, p, p), ("b", q, q, None, None, True, None, True, "ASK", p), ("c", q, q, None, None, True, None, False, p, p), ("d", q, q, None, None, True, None, True, p, " "), ("e", q, q, None, None, True, None, True, None, p)]
    long = metric_long(spark.createDataFrame(rows, SCHEMA + ", pred_placeholder_query string, gold_placeholder_query string"))
    got = {(r["item_id"], r["metric"]): r for r in long.where("metric like 'pgmr_rouge%'").collect()}
    assert [got["a", f"pgmr_rouge{k}_f1"]["value"] for k in "12L"] == [1, 1, 1]
    assert [got["b", f"pgmr_rouge{k}_f1"]["value"] for k in "12L"] == [0, 0, 0]
    assert all(not got[i, "pgmr_rouge1_f1"]["comparable"] and got[i, "pgmr_rouge1_f1"]["reason"] == "prediction_query_missing" for i in "cde")
