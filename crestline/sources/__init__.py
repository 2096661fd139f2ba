"""Where samples come from: tables seen as signals, audio files of several formats, raw PCM, pluggable decoders."""

from crestline.sources import aiff, dsd, flac, mp4, ogg, wav  # noqa: F401  their decoders register themselves
