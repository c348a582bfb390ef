"""The public names in one place."""

from .functions.activation import activations, deactivations, logit, rgb2sh, sh2rgb, sigmoid
from .operators.bounds import chunk_bounds, pack, unpack
from .operators.detect import domains
from .operators.frame import SplatFrame
from .operators.rows import bands, base_row, dense_gid, from_bands, from_base_row
from .schema import SH_C0, degree_of_bands, degree_of_properties
from .sources.ply import PlySource, decompress_bytes, detect_format, read_ply
from .sources.ply_sink import compress_to_bytes, compress_to_tables, write_ply
from .sources.sog import read_bundle
from .state import FormatState
from .streaming.scenes import in_box, packed_rows_in_box, scene_extents, stream_scenes

__all__ = [
    "SH_C0", "FormatState", "PlySource", "SplatFrame", "activations", "bands", "base_row", "chunk_bounds", "compress_to_bytes", "compress_to_tables", "deactivations", "decompress_bytes",
    "degree_of_bands", "degree_of_properties", "dense_gid", "detect_format", "domains", "from_bands", "from_base_row", "logit", "pack", "read_bundle", "read_ply", "rgb2sh", "in_box", "packed_rows_in_box",
    "scene_extents", "sh2rgb", "sigmoid", "stream_scenes", "unpack", "write_ply",
]
