"""Fixed schemas; nothing is inferred from data."""

from pyspark.sql import types as T


def _fields(*pairs):
    return T.StructType([T.StructField(n, t) for n, t in pairs])


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BinaryType()

READ = _fields(("file", S), ("pos", L), ("name", S), ("sequence", S), ("quality", S))
SHEET = _fields(("row_no", I), ("Lane", S), ("Sample_ID", S), ("Sample_Name", S), ("Sample_Project", S), ("index", S), ("index2", S), ("OverrideCycles", S), ("Recipe", S), ("FCID", S))
BARCODES = _fields(("Lane", S), ("Undetermined_Index", S), ("Count", L), ("Fraction", D))
MIXING = _fields(("Lane", S), ("Undetermined_Index", S), ("Count", L), ("Fraction", D), ("Sample_Project", S), ("Lane_Project", S), ("index1", S), ("index2", S))
MATCH = _fields(("errors", I), ("captures", T.ArrayType(S)))
BLOCK = _fields(("lane", L), ("surface", I), ("tile", L), ("cycle", I), ("clusters", L), ("usize", L), ("csize", L), ("block", B))
FILE = _fields(("path", S), ("content", B))
#: Files in parts, which follow each other in order of ``ord``.
PARTS = _fields(("path", S), ("ord", L), ("content", B))
ENTRY = _fields(("ord", L), ("path", S), ("kind", S))

#: Geometry of the flowcell: grid in tenths of a coordinate, and tiles of a lane.
TILE_WIDTH, TILE_HEIGHT, GRID = 320, 160, 10
SURFACES, SWATHS, TILES = 2, 4, 16
#: Offset of coordinates in read names, and the shift of positions in the position files.
ORIGIN, SHIFT = 1000, 1
