import os
import subprocess
import sys
import textwrap

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
    import sys
    sys.path.insert(0, {home!r})
    from datetime import datetime
    from emberlog.operators.patterns import error_burst
    from emberlog.schemas import DETECTION_LOG
    from emberlog.session import build_session
    from emberlog.streaming.detectors import stream_error_burst
    spark = build_session(master="local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false",
                          spark__checkpoint__dir={folder!r} + "/checkpoints")
    rows = [(k, "a", "x", "ERROR", datetime(2024, 1, 1, 0, 0, k)) for k in range(20)]
    logs = spark.createDataFrame(rows, DETECTION_LOG)
    print("BATCH", error_burst(logs).count())
    logs.write.parquet({folder!r} + "/logs")
    stream = spark.readStream.schema(DETECTION_LOG).parquet({folder!r} + "/logs")
    query = (stream_error_burst(stream, "1 minute").writeStream.format("parquet").option("path", {folder!r} + "/out")
             .option("checkpointLocation", {folder!r} + "/state").trigger(availableNow=True).start())
    query.awaitTermination()
    print("STREAM", spark.read.parquet({folder!r} + "/out").count())
"""


def test_runs_from_an_empty_folder(tmp_path):
    (tmp_path / "empty").mkdir()
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS", "SPARK_HOME")}
    script = textwrap.dedent(SCRIPT.format(home=HOME, folder=str(tmp_path)))
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "empty", env=env, capture_output=True,
                          text=True, timeout=300)
    assert "BATCH 1" in done.stdout and "STREAM 1" in done.stdout, done.stderr[-2000:]
