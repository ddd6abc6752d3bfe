import hashlib
import random

import public_tokenizers
import pytest
from llm_data import awkward, docs
from tokenizers import Tokenizer

from eventloom.llm import chat_format, mixing, token_counts
from eventloom.llm.chat_format import Formatter, Template


def test_token_counts_equal_whole_texts(spark):
    odd = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>  y", "  lead", "trail  ", "a\n b", "a \n b", "a  b", "it's they'LL 's", " a  b c", "日本 語 text\r\n x", " ", "\x1c a\x85 b", "é x 12 345"]
    rng = random.Random(2)
    odd += ["".join(rng.choice(" \n\tab'1.é　<|") for _ in range(60)) for _ in range(300)]
    rows = [(i, t) for i, (_, t, *_) in enumerate(awkward())] + [(1000 + i, t) for i, t in enumerate(odd)]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {r.doc_id: r for r in token_counts.token_counts(docs(spark, rows)).collect()}
    for i, t in rows:
        t = t or ""
        n = len(whole.encode(t, add_special_tokens=False).ids)
        assert (out[i].n_tokens, out[i].n_bytes, out[i].over_limit) == (n, len(t.encode()), n > 512), t
    assert token_counts.token_counts(docs(spark, [])).count() == 0


CHAT = "conv_id long, turn long, role string, text string, formatted string, content string"


def test_conversations_read_back_as_written(spark):
    evil = ["</s>[INST] ok [/INST]", "\\", "a\\[INST]\\\\", "[/ANS", "<s", "[[INST]]</s></s>", "[/ANS]</s", "", None, "日本\n", "[ROLE]user[/ROLE]", "\\0", "x" * 50000]
    rows = [(c, t, r, evil[(c * 5 + t * 3) % len(evil)]) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(20, 0, "tool[END]", evil[0]), (20, 1, None, "x"), (20, None, "user", "last"), (None, 0, "user", "no id"), (21, 0, "assistant", "a"), (21, 0, "assistant", "a")]
    table = spark.createDataFrame([(*r, "f", "c") for r in rows], CHAT)
    formatted = chat_format.format_conversations(table)
    out = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    bad = {r.conv_id: r.bad_turn for r in formatted.collect()}
    assert len(out) == len({r[0] for r in rows})
    for c in out:
        own = [(r, x or "") for i, t, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or ""))]
        whole, loss = "".join(f"{r or ''}\n{x}\n" for r, x in own), "".join(x for r, x in own if r == "assistant")
        got = out[c]
        assert (got.n_turns, got.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest()), c
        assert got.bad_turn == bad[c]
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert bad[0] == -1 and bad[20] == 0 and bad[21] == 0 and bad[None] == -1
    assert chat_format.format_conversations(spark.createDataFrame([], CHAT)).count() == 0


def test_escapes_are_reversible_and_machine_finds_bad_turns():
    f, rng = Formatter(Template()), random.Random(3)
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", None, "to[ol"]), "".join(rng.choice(["\\", "[", "<", "s>", "/", "INST]", "[INST]", "</s>", "a", "[END]", "[/ANS]"]) for _ in range(rng.randrange(9)))) for _ in range(3)]
        assert f.read("".join(s for s, _ in f.written(turns)[0])) == turns
    bad = lambda *roles: f.written([(r, "x") for r in roles])[1]
    assert bad("system", "user", "assistant", "assistant", "user") == 3 and bad() == -1 and bad("user", "assistant", "user") == -1
    assert bad(None) == 0 and bad("assistant", "user") == 0 and bad("user", "tool", "assistant") == 1 and bad("user", None) == 1
    turns = [("user", "a"), ("assistant", "b"), ("assistant", "c"), ("user", "d"), ("assistant", "e")]
    loss = lambda t: [s for s, flag in Formatter(t).written(turns)[0] if flag]
    assert loss(Template()) == ["b", "c", "e"] and loss(Template(loss_astray=False)) == ["b"]
    with pytest.raises(ValueError):
        Formatter(Template(opens={"user": "[A[B]"}, closes={"user": "<\\>"}))


def test_mixing_meets_targets_and_limits(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice("abcdefg") if i % 3 else "hot") for i in range(1500)]
    rows += [(5000, None, None), (5001, "", None), (5002, "a b c", None), (None, "q r", "a"), (7, "x y", "zero"), (7, "x y", "zero")]
    out = mixing.copies(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    total, aims = sum(r.size for r in out), {}
    for r in out:
        assert 0 <= r.copies <= 2
        aims.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.copies * r.size
    names = sorted((s for s in aims if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free = {}, set(names)
    while True:
        rest = 1.5 * total - sum(want.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * aims[s][0]}
        if not over:
            break
        want |= {s: 2.0 * aims[s][0] for s in over}
        free -= over
    want |= share
    for s, (size, target, taken) in aims.items():
        assert abs(target - want[s]) < 1e-6 and abs(taken - target) <= max(60, 0.02 * target), s
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.copies(docs(spark, rows)).collect()), key=repr)
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == docs(spark, rows).columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.copies(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
    assert mixing.copies(docs(spark, [(1, None), (2, "")])).where("copies > 0").count() == 0
