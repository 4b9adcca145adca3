"""Row types of the archive."""

from pyspark.sql import types as T

WORD = T.StructType().add("word", "string").add("start", "double").add("end", "double").add("p", "float")
SEGMENT = T.StructType().add("speaker", "string").add("text", "string").add("start_time", "double").add("end_time", "double").add("words", T.ArrayType(WORD))
MODELS = T.StructType().add("segmentation_model", "string").add("vad_model", "string").add("whisper_model", "string")
RESULT = T.StructType().add("segments", T.ArrayType(SEGMENT)).add("created", "timestamp").add("speakers", T.ArrayType(T.StringType())).add("models", MODELS)
TURN = T.StructType().add("speaker", "string").add("text", "string")
ANCHOR = T.StructType().add("tape", "integer").add("label", "string").add("tape_seconds", "double").add("following_text", "string")
TURNS_FILE = T.StructType().add("turns", T.ArrayType(TURN))
ANCHORS_FILE = T.StructType().add("anchors", T.ArrayType(ANCHOR))

_AUDIO = T.StructType().add("resample_chunk", "integer").add("sinc_len", "integer").add("f_cutoff", "double").add("oversampling_factor", "integer").add("interpolation", "string")
_VAD = T.StructType().add("enabled", "boolean").add("max_speech_duration_s", "double")
_DECODE = T.StructType().add("language", "string").add("beam_size", "integer").add("entropy_thold", "double").add("no_context", "boolean")
_DIARIZE = T.StructType().add("enabled", "boolean").add("max_speakers", "integer")
CONFIG = T.StructType().add("audio", _AUDIO).add("vad", _VAD).add("decode", _DECODE).add("diarize", _DIARIZE)

#: Fixed values of a configuration whose fields are left out.
CONFIG_DEFAULTS = {
    "audio": {"resample_chunk": 4096, "sinc_len": 256, "f_cutoff": 0.95, "oversampling_factor": 256, "interpolation": "linear"},
    "vad": {"enabled": True, "max_speech_duration_s": 60.0},
    "decode": {"language": "en", "beam_size": 5, "entropy_thold": 3.0, "no_context": True},
    "diarize": {"enabled": True, "max_speakers": 4},
}
