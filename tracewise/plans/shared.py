"""Tables that several queries of the catalogue read, computed once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from tracewise.operators import fingerprint as fpm
from tracewise.session import checkpoint_dir
from tracewise.sources import io
from tracewise.sources.fixtures import doc_steps
from tracewise.sources.tables import table


def _version(df: DataFrame) -> str:
    """Names, sizes and times of the files that a table is read from."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = []
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        status = path.getFileSystem(conf).getFileStatus(path)
        files.append((f, status.getLen(), status.getModificationTime()))
    return hashlib.md5(repr(files).encode()).hexdigest()


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, written once for a version of the table and read by all that need it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/fingerprints-{_version(table(spark, sf_dir, 'documents'))}"
    return io.cached(spark, path, lambda: fpm.fingerprint(doc_steps(spark, sf_dir)))
