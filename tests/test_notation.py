"""Numbers of games in notation files that several tasks read."""

from rookery.sources import logs


def test_games_are_numbered_over_the_blocks_of_a_file(spark, tmp_path):
    for run, n in (("one", 300), ("two", 40)):
        (tmp_path / run).mkdir()
        games = []
        for i in range(n):
            # every third game opens with another tag, every fifth has no number
            first = '[Site "s"]\n' if i % 3 == 1 else '[Event "e"]\n'
            number = "?" if i % 5 == 0 else str(1000 + i)
            games.append(f'{first}[Round "{number}"]\n[White "w{i}"]\n\n1. e4 e5 {{{"x" * (i % 90)}}} 2. Nf3 *\n')
        (tmp_path / run / "games.pgn").write_text("\n".join(games))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        paths = f"{tmp_path}/*/games.pgn"
        assert spark.read.option("lineSep", "[Event ").text(paths).rdd.getNumPartitions() > 2
        df = logs.read_pgn(spark, paths)
        got = sorted((r.run_id, r.seq, r.idx, r.headers["White"], len(r.sans)) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [
        (run, i, i if i % 5 == 0 else 1000 + i, f"w{i}", 3) for run, n in (("one", 300), ("two", 40)) for i in range(n)
    ]
