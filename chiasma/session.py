"""Session factory used by the tests, the bench and interactive work."""

from pyspark.sql import SparkSession


def get_session(app: str = "chiasma", master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; on a cluster the submit settings win over these."""
    return (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir). Where that is unset, a local
    session, as in tests, takes a temporary folder of this machine; on a cluster each executor would write to its own, so
    there it is an error. A session's folders go when its driver ends."""
    import atexit
    import re
    import tempfile
    import uuid

    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="chiasma-")
        spark.conf.set("spark.checkpoint.dir", top)
        sc.setCheckpointDir(top)
    own = f"{top.rstrip('/')}/chiasma/{sc.applicationId}"
    if getattr(sc, "_chiasma_dir", None) != own:
        sc._chiasma_dir = own
        atexit.register(delete, sc, own)
    return f"{own}/{uuid.uuid4().hex}"


def delete(sc, path: str) -> None:
    """Deletes a folder of whichever file system, while the context runs."""
    if sc._jsc is not None:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once for each context. Nothing is sent where they find it by
    themselves: by PYTHONPATH, or in the working folder of a local session."""
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(package)
    places = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if top in map(os.path.realpath, places) or top in places or sc.master.startswith("local") and os.path.realpath(os.getcwd()) == os.path.realpath(top) or getattr(sc, "_chiasma", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="chiasma-"), "chiasma.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
    sc.addPyFile(path)  # the driver serves it to executors
    sc._chiasma = True
