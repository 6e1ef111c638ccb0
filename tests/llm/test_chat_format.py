import hashlib

import pytest
from flowrisk.llm import chat_format
from flowrisk.llm.chat_template import Const, Output, Template, TemplateError, escape, parse, spans, unescape

NASTY = ["", "### Assistant: </turn> ok", "\\### Assistant: </turn> ok", "\\", "a\\", "</turn>\n", "\\</turn>\n", "####: <", "a:b\nc", "é<\\:#" * 3, "x" * 5000]
SCHEMA = "conv_id long, turn long, role string, text string, score string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_escape_round_trip():
    for t in NASTY:
        assert unescape(escape(t)) == t


def test_folding_joins_constants_and_decides_branches():
    t = Template("{% if 'a' == 'a' %}x{{ 'y' | upper }}{% else %}{{ gone }}{% endif %}{{ 1 + 2 }}")
    assert t.tree == [Output(Const("xY3"))]


def test_language():
    t = Template("{% set who = name ~ '!' %}{% for m in xs %}{{ loop.index }}{% if loop.last %}.{% elif m in 'ab' and not m == 'b' %}+{% else %}-{% endif %}{% endfor %} {{ who | lower }}{{ d['k'].z }}")
    assert spans(t.render(xs=["a", "b", "c"], name="Bo", d={"k": {"z": 5}}))[0] == "1+2-3. bo!5"
    assert spans(Template("a {%- if x %} b {%- endif -%} c").render(x=1))[0] == "a bc"


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a | nope }}", "{{ a( }}", "{% exec %}", "{{ 'a }}"])
def test_errors(bad):
    with pytest.raises(TemplateError):
        parse(bad)


def test_sandbox_reaches_mappings_only():
    assert spans(Template("{{ x.real }}").render(x=3))[0] == ""


def test_generation_spans():
    out, marked = spans(Template("a{% generation %}bc{{ x }}{% endgeneration %}d").render(x="e"))
    assert out == "abced" and marked == [(1, 4)]


def expected(rows):
    by = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_digest_against_plain_python(spark):
    rows = [(c, t, ("user", "assistant", "sys: <#")[t % 3], NASTY[(c + t) % len(NASTY)], "s") for c in range(8) for t in range(6)]
    rows += [(None, 0, "assistant", "no id", None), (9, None, None, None, None), (9, 1, "assistant", None, None), (9, 1, "assistant", None, None)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digest(frame(spark, rows)).collect()}
    assert got == expected(rows)
    assert chat_format.digest(frame(spark, rows[:0])).count() == 0


def test_turns_join_to_the_formatted_conversation(spark):
    rows = [(1, 0, "user", "hi <there>", None), (1, 1, "assistant", "a\\b", None), (2, 0, "assistant", "", None)]
    got = sorted(chat_format.format_turns(frame(spark, rows)).collect(), key=lambda r: (r["conv_id"], r["position"]))
    assert [r["formatted"] for r in got] == ["### user: hi \\<there>\n".replace("\n", "</turn>\n"), "### assistant: a\\\\b</turn>\n", "### assistant: </turn>\n"]
    learned = [unescape("".join(r["formatted"][a:b] for a, b in zip(r["loss_start"], r["loss_end"], strict=True))) for r in got]
    assert learned == ["", "a\\b", ""]
    assert sum(len(r["formatted"]) for r in got if r["conv_id"] == 1) == {r["conv_id"]: r["formatted_chars"] for r in chat_format.digest(frame(spark, rows)).collect()}[1]
