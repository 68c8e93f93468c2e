import hashlib

import pytest

from cairnflow.llm import chat
from cairnflow.llm.chat_template import Template, TemplateError, escape, parse, unescape


def test_constants_are_folded():
    assert parse("{{ 1 + 2 * 3 }}{{ 'a' ~ \"b\" | upper }}") == ("block", ("text", "7aB"))
    assert parse("{% if 1 < 2 %}yes{% else %}no{% endif %}!") == ("block", ("text", "yes!"))
    assert parse("a {#- note -#} b") == ("block", ("text", "ab"))


def test_rendering():
    t = Template("{% set n = 'N' %}{% for m in messages %}{{ loop.index }}:{{ m.role }}{% if loop.last %}.{% elif m['role'] in ('a' ~ 'b') %};{% else %},{% endif %}{% endfor %}{{ n }}{{ x|default('d') }}")
    assert t.render([{"role": "a"}, {"role": "c"}, {"role": "b"}])[0] == "1:a;2:c,3:b.Nd"
    t = Template("<{% for m in messages %}{% if m.role == 'assistant' %}{% generation %}{{ m.text }}{% endgeneration %}{% else %}{{ m.text }}{% endif %}|{% endfor %}")
    text, spans = t.render([{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}])
    assert text == "<hi|yo|" and [text[a:b] for a, b in spans] == ["yo"]


@pytest.mark.parametrize("text", ["{{ f(1) }}", "{{ x|eval }}", "{% while 1 %}{% endwhile %}", "{% if 1 %}", "{{ 'a' }", "{% endfor %}", "{{ import os }}", "{{ 1 + }}"])
def test_what_is_not_allowed_fails(text):
    if text == "{{ 'a' }":
        assert Template(text).render([])[0] == text
    else:
        with pytest.raises(TemplateError):
            Template(text)


def test_no_way_to_python_objects():
    assert Template("{{ m.__class__ }}{{ ''.__class__ }}").render([], m={})[0] == ""
    with pytest.raises(TemplateError):
        Template("{{ m.real }}").render([], m=5)
    with pytest.raises(TemplateError):
        Template("{{ 'a' * 1000000000 }}")


def test_escape_is_reversible():
    for x in ("", "\\", "\\\\(", "</s>[INST] ok [/INST]", "[<\\{(", "plain"):
        assert unescape(escape(x)) == x and "[" not in escape(x) and "<" not in escape(x)


def want(rows):
    turns = sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
    loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
    return len(rows), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 40)
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b </s>[OUT] x"), (1, 1, "assistant", "b </s>[OUT] x"), (2, 0, None, None), (2, 1, "assistant", None), (2, 2, "[TEXT] r\n", " [/ROLE] "), (3, 5, "user", " "), (3, 4, "assistant", "\\" * 3), (4, 0, "user", "long " * 20000), (4, None, "assistant", "é😀" * 300)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chat.format_conversations(df, "conv_id", "turn", "role", "text")).collect()}
    assert got == {k: want([r for r in rows if r[0] == k]) for k in (1, 2, 3, 4)}
    assert chat.read_back(chat.format_conversations(df.where("false"), "conv_id", "turn", "role", "text")).count() == 0
