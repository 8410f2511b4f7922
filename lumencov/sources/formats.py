"""Fixed values of the two-part report format."""

HEADER_END = "\n<<<<< end_of_header >>>>>\n"
CHUNK_END = "\n<<<<< end_of_chunk >>>>>\n"
EMPTY_CHUNK = "null"

#: Key of a session in the report JSON, and the upload's column.
SESSION_KEYS = {
    "d": "timestamp",
    "a": "raw_upload_url",
    "f": "flags",
    "c": "provider",
    "n": "build",
    "N": "name",
    "j": "job_name",
    "u": "ci_run_url",
    "p": "state",
    "e": "env",
    "st": "session_type",
    "se": "session_extras",
}
