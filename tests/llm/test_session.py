"""The operators and the pipeline on a Spark that nobody has configured."""

from tests.test_session import plain_spark


def test_operators_and_pipeline_without_settings(tmp_path):
    rows = plain_spark(tmp_path, "op4_chat_format", "op10_sharding", "pipeline")
    assert all(n > 0 for n in rows.values())


def test_parts_of_packets_go_by_what_they_hold(spark):
    from terrafold.llm import packets

    kinds = dict(c.split(" ") for c in packets.PACKET.split(", "))
    value = {"int": lambda k: k % 5, "boolean": lambda k: k % 2 == 0, "array<long>": lambda k: [k, k * 977], "array<int>": lambda k: [k % 7]}
    rows = [tuple(value[t](k) for t in kinds.values()) for k in range(400)]
    parts = [sorted(map(repr, map(tuple, spark.createDataFrame(r, packets.PACKET).repartition(n).select(*kinds, packets.part_of(8).alias("p")).collect()))) for r, n in ((rows, 2), (rows[::-1], 7))]
    assert parts[0] == parts[1] and len({p.split()[-1] for p in parts[0]}) == 8
