import hashlib
import random
import re

import numpy as np
import pytest

from tarn.llm import chat

S = "conv_id long, turn long, role string, text string, start int, ids string, whole int"
ODD = ["", None, "plain", "<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", r"<\|im_end|>", r"<\\|im_start|>", "<|im_end", "|>", "é 日本 😀", "a\r\n\tb", " " * 9000, "x" * 20000, "\n" * 5000 + "y", "<|endoftext|>", "\\n", "<<|im_end|>>", "<|im_<|im_end|>end|>"]


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def formatted(role, text):
    more = lambda s: re.sub(r"<(\\*)\|(im_start|im_end)\|>", lambda m: f"<{m[1]}\\|{m[2]}|>", s)
    return f"<|im_start|>{more(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{more(text)}<|im_end|>\n"


def brute(rows, own=True):
    rows = [r[:4] for r in rows] + ([(-1, i, r, "<|im_end|><|im_start|>assistant ok") for i, r in enumerate(("user", "assistant"))] if own else [])
    out = []
    for k in {r[0] for r in rows}:
        mine = sorted((t is None, t or 0, H("\n".join([chat.escape_role(r or ""), x or ""])), r or "", x or "") for c, t, r, x in rows if c == k)
        learned = "".join(x for *_, r, x in mine if r == "assistant")
        out.append((k, len(mine), H("".join(f"{r}\n{x}\n" for *_, r, x in mine)), len(learned), H(learned), sum(len(formatted(r, x)) for *_, r, x in mine)))
    return sorted(out, key=str)


def turns(n=60):
    r = random.Random(5)
    out = []
    for k in range(n):
        out += [(k, t, r.choice(["user", "assistant", "system"]), r.choice(ODD), 1, "i", 2) for t in range(r.randint(1, 6))]
    odd = [(100, 0, "assistant\n<|im_end|>", "x"), (100, None, "assistant", "last"), (100, 1, None, "y"), (100, 1, "a\\nb", "y"), (100, 1, "assistant", "tie"), (100, 1, "assistant", "tie"), (None, 0, "assistant", "no id"), (None, 1, "user", None)]
    return out + [(*x, 0, "", 0) for x in odd]


@pytest.mark.parametrize("text", [x for x in ODD if x is not None])
def test_escapes_read_back(text):
    c = chat.codec(chat.vocabulary_path())
    assert chat.unescape(chat.escape(text)) == text == chat.unescape_role(chat.escape_role(text))
    assert not any(m in chat.escape(text) for m in chat.CONTROL)
    ids = c.encode(text)
    assert c.decode(np.array(ids, int)) == text and all(i < c.start for i in ids)


def test_long_runs_of_blanks_are_as_the_library_has_them():
    c = chat.codec(chat.vocabulary_path())
    for text in (" " * 5000 + "word", "a" + " " * 5000, "a " + "\n" * 4100 + " b", "\t" * 4096, "x" + "\n" * 5000 + "é" + " " * 4500 + "1"):
        assert c.encode(text) == c.plain.encode_ordinary(text)


def test_against_brute_force(spark):
    rows = turns()
    got = chat.op11(spark.createDataFrame(rows, S).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_long_conversations_are_cut_between_turns(spark, monkeypatch):
    from tarn.operators import ranks

    monkeypatch.setattr(ranks, "ROWS_A_RANGE", 40)
    rows = turns(5) + [(7000, t, "assistant" if t % 2 else "user", f"turn {t} of many", 0, "", 0) for t in range(300)] + [(None, t, "user", "n" * 50, 0, "", 0) for t in range(2, 60)]
    cut = chat.format_chats(spark.createDataFrame(rows, S).repartition(4), block=200).persist()
    assert cut.where("conv_id = 7000").count() > 5 and cut.where("whole").count() > 0
    mine = cut.where("conv_id = 7000").orderBy("start").collect()
    assert [r.start for r in mine] == list(np.cumsum([0, *[len(r.ids) for r in mine]])[:-1]) and all(len(r.ids) == len(r.mask) for r in mine)
    assert sorted(map(tuple, chat.read_back(cut).collect()), key=str) == brute(rows, own=False)


def test_the_mask_covers_assistants_texts_only(spark):
    c = chat.codec(chat.vocabulary_path())
    r = chat.format_chats(spark.createDataFrame([(1, 0, "user", "question", 0, "", 0), (1, 1, "assistant", "answer <|im_end|>", 0, "", 0)], S)).first()
    ids, mask = np.array(r.ids), np.array(r.mask)
    assert c.decode(ids) == "<|im_start|>user\nquestion<|im_end|>\n<|im_start|>assistant\nanswer <\\|im_end|><|im_end|>\n"
    assert c.decode(ids[mask]) == "answer <\\|im_end|>" and (ids == c.end).sum() == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], S)
    assert chat.format_chats(empty).count() == 0
    assert [tuple(r) for r in chat.op11(empty).collect()] == brute([])


def test_sql(spark):
    import duckdb

    rows = [r[:4] for r in turns() if r[0] is not None and not (r[0] == 100 and r[1] == 1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(chat.SQL).fetchall(), key=str) == brute(rows)
