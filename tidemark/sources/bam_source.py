"""BAM as a Spark data source: ``register(spark)``, then ``spark.read.format("bam").load(path)`` and
``df.write.format("bam").mode("append").option("header", text).save(path)``.

Large files are read by several tasks (option ``splitBytes`` of compressed size, 32 MB). A task finds the first block in
its split by its checksum, and the first record by what records must look like: a chain of CHAIN records of which every field
fits, up to the last byte of the tags. A record belongs to the split in whose blocks it begins.

Filters on ``chrom`` (=, IN) and bounds on ``pos`` are applied while decoding; where a file has an index beside it
(``x.bam.bai``), they also choose what is read at all, as does the option ``region`` (like ``chr1:1,000-2,000``, several by
semicolons; rows that overlap one of them). About a megabyte of records is decoded at once, so memory does not grow with
the file."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource

from tidemark.sources.bam import SCHEMA
from tidemark.sources.bam_arrow import BamArrowReader, BamArrowWriter
from tidemark.sources.bgzf import SPLIT


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamArrowReader:
        return BamArrowReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)), self.options.get("region"))

    def writer(self, schema, overwrite: bool):
        return BamArrowWriter(self.options["path"], self.options["header"], schema.names, overwrite, self.options.get("integerTags"))


def register(spark) -> None:
    """Makes the format known to the session and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
