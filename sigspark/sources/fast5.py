"""FAST5 (HDF5) signal files. Needs h5py, which is looked for when a file is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = ("read_id string, raw array<smallint>, digitisation double, offset double, range double, "
          "sampling_rate double, file string")
VBZ_FILTER = 32020


def _h5py():
    try:
        import h5py
    except ImportError as error:
        raise RuntimeError("reading FAST5 files needs the h5py package on every executor") from error
    return h5py


def _reads(h5, file: str):
    """(group holding Raw, channel attributes) of every read of a single or multi read file."""
    version = h5.attrs.get("file_version", b"0")
    version = version.decode() if isinstance(version, bytes) else str(version)
    if float(version.split(".")[0] or 0) >= 1:
        for name in h5:
            raw, channel = h5[name]["Raw"], h5[name]["channel_id"].attrs
            yield raw.attrs["read_id"], raw["Signal"], channel
        return
    channel = h5["UniqueGlobalKey/channel_id"].attrs
    for raw in h5["Raw/Reads"].values():
        yield raw.attrs["read_id"], raw["Signal"], channel


def _row(read_id, signal, channel, file: str) -> dict:
    if VBZ_FILTER in [signal.id.get_create_plist().get_filter(i)[0]
                      for i in range(signal.id.get_create_plist().get_nfilters())]:
        try:
            samples = signal[()]
        except OSError as error:
            raise RuntimeError(f"{file} is VBZ compressed: its HDF5 filter is not installed") from error
    else:
        samples = signal[()]
    name = read_id.decode() if isinstance(read_id, bytes) else str(read_id)
    return {"read_id": name, "raw": samples.tolist(), "digitisation": float(channel["digitisation"]),
            "offset": float(channel["offset"]), "range": float(channel["range"]),
            "sampling_rate": float(channel["sampling_rate"]), "file": file}


def read_fast5(spark: SparkSession, directory: str, tasks: int | None = None) -> DataFrame:
    """Signals of all FAST5 files under a directory, one file at a time per task."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.fast5").load(directory).select("path"))
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pandas as pd
        h5py = _h5py()
        for frame in batches:
            for path in frame["path"]:
                local = path.replace("file:", "", 1)
                with h5py.File(local, "r") as h5:
                    for read in _reads(h5, local):
                        yield pd.DataFrame([_row(*read, path)])

    return files.repartition(n, F.col("path")).mapInPandas(run, SCHEMA)
