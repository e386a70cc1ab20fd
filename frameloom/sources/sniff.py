"""What kind of file is it: decided by its first four bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.numeric import col

# Leading bytes, in hex, of the recognised formats.
JPEG_MAGIC = "FFD8FF"
PNG_MAGIC = "504E47"  # bytes 2 to 4
TIFF_MAGICS = ("4D4D", "4949")
VPP_MAGIC = "56505000"
NPY_MAGIC = "934E554D"


def file_format(content) -> Column:
    """Format name of a binary column: jpeg, png, tiff, vpp, npy or other."""
    head = F.hex(F.substring(col(content), 1, 4))
    return (
        F.when(head.startswith(JPEG_MAGIC), F.lit("jpeg"))
        .when(F.substring(head, 3, 6) == PNG_MAGIC, F.lit("png"))
        .when(F.substring(head, 1, 4).isin(*TIFF_MAGICS), F.lit("tiff"))
        .when(head == VPP_MAGIC, F.lit("vpp"))
        .when(head == NPY_MAGIC, F.lit("npy"))
        .otherwise(F.lit("other"))
    )
