import hashlib
import random

import duckdb
import pytest

from sensorframe.llm import chat, queries

SCHEMA = f"conv_id long, turn long, role string, parts {chat.PARTS}, block string, formatted int"


def part(kind="text", text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_parts_become_placeholders_in_order(spark):
    parts = [part(text="see "), part("image", ref="a.png", width=57, height=28), part(text="<"), part(text="|image|>")]
    parts += [part("audio", ref="b.wav", seconds=2.5), part("document", ref="c.pdf", pages=3), part("image"), None]
    row = chat.format_chat(turns(spark, [(1, 0, "assistant", parts), (1, 1, "user", None)])).collect()
    assert len(row) == 1
    row = row[0]
    content = "see <|image|><\\|image|><|audio|><|document|><|image|>"
    assert row["formatted"] == f"<|im_start|>assistant\n{content}<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    found = [(a["number"], a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]]
    assert found == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 63), (2, "document", "c.pdf", 1536), (3, "image", None, 1)]
    for a in row["attachments"]:
        assert row["formatted"][a["start"] :].startswith(f"<|{a['kind']}|>")
    assert row["tokens"] == 3 + 63 + 1536 + 1
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss"]] == [content]
    assert chat.read_loss(row["formatted"], row["loss"]) == ["see <|image|>"]


def test_control_strings_come_back():
    rng = random.Random(1)
    for _ in range(3000):
        role = "".join(rng.choices("<|\\\nan>", k=rng.randint(0, 6)))
        texts = ["".join(rng.choices("<|\\>\nim_start", k=rng.randint(0, 12))) for _ in range(2)]
        piece = chat._Piece((1, 0), 0)
        visitor = chat.Visitor()
        for text in texts:
            parts = [dict(zip(("kind", "text", "ref", "width", "height", "seconds", "pages"), part(text=text)))]
            content = visitor.content(parts)
            assert "<|" not in content
            piece.add(role, content, [], True)
        written = "".join(piece.texts)
        assert chat.read_turns(written) == [(role, t) for t in texts]
        assert chat.read_loss(written, piece.loss) == texts


@pytest.mark.parametrize("block, piece", [(1024, 1 << 20), (3, 40)])
def test_digests_against_plain_python(spark, block, piece):
    """A conversation with most turns, nulls, ties and repeated rows; pieces of all sizes."""
    rng = random.Random(block)
    rows = [(7, t, "assistant", "x" * rng.randint(0, 9) + "<|im_end|>" * (t % 5 == 0)) for t in range(400)]
    rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "b\n"])) for c in range(40) for t in range(3)]
    rows += [(None, 0, "user", "n"), (None, None, "user", "first"), (3, 1, "user", "tie"), (3, 1, "user", "tie")]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.withColumn("parts", chat.text_part(table["text"]))
    pieces = chat.format_chat(table, block=block, piece=piece)
    got = {r["conv"]: r for r in chat.conversation_digests(pieces).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv, r in got.items():
        mine = [(t is not None, t or 0, role is not None, role or "", text is not None, text or "") for c, t, role, text in rows if c == conv]
        mine = [(m[3], m[5]) for m in sorted(mine)]
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        loss = "".join(b for a, b in mine if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(24 + len(a) + len(chat.escape(b)) for a, b in mine)
    whole = {}
    for r in pieces.orderBy("conv", "block", "piece").collect():
        whole[r["conv"]] = whole.get(r["conv"], "") + r["formatted"]
        assert piece > 40 or r["n_turns"] <= 3
    assert {c: len(t) for c, t in whole.items()} == {c: r["formatted_chars"] for c, r in got.items()}


def test_empty_table(spark):
    empty = chat.format_chat(turns(spark, []))
    assert empty.count() == 0
    assert chat.conversation_digests(empty).count() == 0


def test_query_against_sql(spark, sf_dir):
    got = queries.QUERIES["op11_chat_format"](spark, sf_dir).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.execute(queries.SQL["op11_chat_format"]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (set(map(tuple, x[columns].astype(str).to_numpy())) for x in (got, want))
    assert a == b and len(got) == len(want)
