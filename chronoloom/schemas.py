"""Schemas of the tables that pipelines exchange, as DDL."""

FRAMES = "video string, idx long, t_us long, path string, is_keyframe boolean"
OCR = "video string, ord long, t_us long, lines array<string>"
DESCRIPTIONS = "video string, ord long, t_us long, action string, app string, resource string, location string, focus string"
SEGMENTS = "video string, ord long, start_us long, end_us long, text string, no_speech_prob double, avg_logprob double, speaker string"
ENTRIES = (
    "video string, ord long, t_us long, end_us long, duration_us long, action string, app string, resource string, location string, focus string, "
    "ocr array<string>, speech array<string>, summary string, frame string"
)
#: A line of a stored work log; older files lack t_end and duration_seconds, which read as null.
WORKLOG = (
    "t string, t_end string, duration_seconds double, app_guess string, resource string, location string, focus string, ocr array<string>, "
    "speech array<string>, summary string, frame string, action string"
)


def names(ddl: str) -> list[str]:
    """The columns of a flat schema."""
    return [column.split()[0] for column in ddl.split(", ")]
