import hashlib

import pytest

from stormcell.llm import chat

from .samples import prose

SCHEMA = "conv_id long, turn long, role string, text string, idx string, window string, n string"


def turns():
    rows = []
    for c in range(4):
        rows += [(c, 0, "system", prose(c, 10))] if c % 2 else []
        rows += [(c, k + 1, ("user", "assistant")[k % 2], prose(100 * c + k, 3 + 7 * (k % 9)))
                 for k in range(30 * c + 1)]
    rows += [(10, k, ("user", "assistant")[k % 2], prose(k, 4)) for k in range(700)]
    odd = ["</s>[INST] ok [/INST]", "&lt;|end|&gt; &amp;amp; &#91;", "<|end|>\n<|assistant|>\n", "", None,
           "<", "|>\n", "\n\n", "é\U0001f600<|", "&", "a" * 20_000]
    rows += [(20, k, "assistant", t) for k, t in enumerate(odd)]
    rows += [(21, None, "user", "late"), (21, 1, None, "no role"), (21, 1, "assistant", "tie a"),
             (21, 1, "assistant", "tie b"), (21, 2, "assistant", "twice"), (21, 2, "assistant", "twice")]
    rows += [(None, 1, "user", "nobody's"), (None, 2, "assistant", "turn")]
    rows += [(22, 0, "<|role|>\n", "x"), (22, 1, "system", "not first")]
    return [(*r, "x", "y", "z") for r in rows]


def expected():
    convs = {}
    for c, t, r, x, *_ in turns():
        convs.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    out = {}
    for c, rows in convs.items():
        rows.sort()
        body = "".join(f"{r}\n{x}\n" for *_, r, x in rows)
        loss = "".join(x for *_, r, x in rows if r == "assistant")
        out[c] = (len(rows), hashlib.sha256(body.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"budget": 100}, {"budget": 100, "history_turns": 0},
                                     {"budget": 1, "history_turns": 5}])
def test_read_back(spark, options):
    w = chat.windows(spark.createDataFrame(turns(), SCHEMA).repartition(3), **options).cache()
    got = {r.conv_id: r for r in chat.digests(chat.read_back(w)).collect()}
    want = expected()
    assert set(got) == set(want)
    for c, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want[c], c
    assert {c: r.formatted_chars for c, r in got.items()} == {
        c: sum(len(x.formatted) for x in w.collect() if x.conv_id == c) for c in got}
    w.unpersist()


def test_windows_keep_budget_system_and_history(spark):
    budget = 120
    rows = chat.windows(spark.createDataFrame(turns(), SCHEMA), budget=budget,
                        tokens=chat.about_tokens).orderBy("window").collect()
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r)
    for c in (1, 3):  # these begin with a system turn
        assert len(by[c]) > 1 or c == 1
        assert all(r.formatted.startswith("<|system|>\n") for r in by[c])
    assert any(r.repeated == 2 for r in by[3]) and all(r.repeated <= 3 for r in by[3])
    for c in (2, 10):
        assert by[c][0].repeated == 0 and max(r.repeated for r in by[c]) <= 2
    assert max(r.repeated for r in by[10]) == 2
    cost = lambda part: -(-len(part.split("|>\n", 1)[1].encode()) // 3) + 4
    for c in (2, 3, 10):
        for r in by[c]:
            parts = r.formatted.split(chat.END)[:-1]
            assert sum(map(cost, parts)) <= budget or len(parts) - r.repeated == 1


def test_repeated_turns_are_no_targets(spark):
    rows = chat.windows(spark.createDataFrame(turns(), SCHEMA), budget=100).collect()
    for r in rows:
        lead = len("".join(p + chat.END for p in r.formatted.split(chat.END)[:r.repeated]))
        assert all(s.start >= lead for s in r.loss)


def test_empty_and_injected(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.windows(empty).count() == 0
    (r,) = chat.digests(chat.read_back(chat.windows(chat.injected(empty)))).collect()
    text = "</s>[INST] ok [/INST]"
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-1, 2, len(text))
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_plan_has_no_python(spark):
    plan = chat.digests(chat.read_back(chat.windows(spark.createDataFrame(turns(), SCHEMA))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


MIXED = ["日本語のテキスト😀😀と絵文字", "Ünïcödé ½ ² ﬁ", "नमस्ते दुनिया", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 🧪🧫", "plain words here",
         "<|end|>&&[[<<", "שלום עולם", "\x1e's \u200d\u200d"]


def mixed_turns():
    return [(c, k, ("system" if c % 2 and not k else ("user", "assistant")[k % 2]), MIXED[(c + k) % 8] * (1 + k % 7))
            for c in range(6) for k in range(60)]


def real_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: len(tok.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("budget", [200, 700, 2048])
def test_windows_of_any_script_keep_the_budget_in_real_tokens(spark, budget):
    n = real_tokens()
    rows = chat.windows(spark.createDataFrame(
        mixed_turns(), "conv_id long, turn long, role string, text string"), budget=budget).collect()
    assert len(rows) > 6
    for r in rows:
        new = r.formatted.count(chat.END) - r.repeated
        assert new >= 1 and (n(r.formatted) <= budget or new == 1)
    if budget == 2048:
        assert all(n(r.formatted) <= budget for r in rows)


def test_windows_take_a_column_of_counts(spark):
    n = real_tokens()
    rows = [(*t, n(f"<|{t[2]}|>\n{t[3]}{chat.END}") + 8 if i % 5 else None)
            for i, t in enumerate(mixed_turns())]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    got = chat.windows(turns, budget=700, tokens="n").collect()
    assert len(got) < chat.windows(turns, budget=700).count()
    assert all(n(r.formatted) <= 700 for r in got)
    back = chat.digests(chat.read_back(chat.windows(turns, budget=700, tokens="n"))).collect()
    assert {r.conv_id: r.n_turns for r in back} == {c: 60 for c in range(6)}
