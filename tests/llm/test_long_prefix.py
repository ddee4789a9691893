"""Turns that very many or very long conversations share are emitted once for what the conversations add, not once for each."""

from trackloom.llm import chat


def test_long_and_hot_prefix(spark):
    schema = "conv_id long, turn long, role string, text string"
    for long in (40_000, 200_000, 500):
        first = "p" * long
        talk = [(k, t, *x) for k in range(300) for t, x in enumerate([("user", first), ("assistant", f"answer {k}")])]
        df = spark.createDataFrame(talk, schema).coalesce(1)
        packs = chat.pack_conversations(df).collect()
        emitted = sum(p["text"].count("[INST]") for p in packs)
        spread = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
        assert emitted <= int(spread) and sum(len(p["conversations"]) for p in packs) == 300
        got = {r["conv_id"]: r for r in chat.read_back(chat.pack_conversations(df)).collect()}
        assert len(got) == 300 and all(r["n_turns"] == 2 and r["loss_chars"] == len(f"answer {k}") for k, r in got.items())
