from flowrisk.operators import contract as CT
from flowrisk.schema import FLOW_SCHEMA, MODEL_FEATURES


def full_frame(spark, drop=None, extra=False, null_label=False, wrong_type=False):
    fields = [f for f in FLOW_SCHEMA.fields if f.name != drop]
    ddl = ", ".join(f"`{f.name}` {('string' if wrong_type and f.name == 'Flow Duration' else f.dataType.simpleString())}"
                    for f in fields)
    if extra:
        ddl += ", `Extra Col` int"
    row = []
    for f in fields:
        if f.name == "Label":
            row.append(None if null_label else "Botnet")
        elif wrong_type and f.name == "Flow Duration":
            row.append("5")
        elif f.dataType.simpleString() == "double":
            row.append(1.0)
        else:
            row.append(1)
    if extra:
        row.append(1)
    return spark.createDataFrame([tuple(row)], ddl)


def test_contract_holds_on_full_record(spark):
    df = full_frame(spark)
    assert CT.missing_features(spark, df).count() == 0
    assert CT.contract_ok(df).first().contract_ok is True
    assert len(CT.non_feature_columns(spark, df).collect()) == len(FLOW_SCHEMA.fields) - 1 - len(MODEL_FEATURES)


def test_missing_feature_extra_column_null_and_type(spark):
    df = full_frame(spark, drop="Idle Min", extra=True, null_label=True, wrong_type=True)
    assert [r.feature for r in CT.missing_features(spark, df).collect()] == ["Idle Min"]
    assert "Extra Col" in [r.column_name for r in CT.non_feature_columns(spark, df).collect()]
    ok = CT.contract_ok(df).first()
    assert (ok.missing_count, ok.critical_nulls, ok.contract_ok) == (1, 1, False)
    status = {r.column_name: r.status for r in CT.schema_diff(spark, df).collect()}
    assert status["Idle Min"] == "missing" and status["Extra Col"] == "extra"
    assert status["Flow Duration"] == "type_mismatch" and status["Label"] == "ok"
    nulls = {r.column_name: (r.null_count, r.critical) for r in CT.null_counts(df).collect()}
    assert nulls["Label"] == (1, True)
    assert [r.label for r in CT.label_values(df).collect()] == []


def test_contract_document_and_json(spark):
    import json
    import os

    from flowrisk.session import scratch_path

    df = full_frame(spark, drop="Idle Min", null_label=True)
    doc = CT.contract_document(df).first()
    assert doc.row_count == 1 and doc.column_count == len(FLOW_SCHEMA.fields) - 1
    assert doc.missing_selected_features == ["Idle Min"]
    assert doc.critical_field_nulls == {"Label": 1, "Destination Port": 0, "Flow Duration": 0}
    assert doc.null_counts["Label"] == 1 and doc.label_values == []
    assert doc.contract_ok is False and doc.selected_feature_count == len(MODEL_FEATURES)
    path = scratch_path(spark, "t-contract")
    CT.write_contract(CT.contract_document(full_frame(spark)), path)
    part = [f for f in os.listdir(path) if f.endswith(".json")][0]
    body = json.loads(open(os.path.join(path, part)).readline())
    assert body["contract_ok"] is True and body["label_values"] == ["Botnet"]
