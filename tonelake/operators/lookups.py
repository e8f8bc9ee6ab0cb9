"""Equi-lookups in small fixed tables: MIME types, tag labels, file extensions, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.plans.settings import EVENTS

# MIME types by codec or playlist format.
MIME = {
    "MP3": ["audio/mpeg", "audio/mpeg3", "audio/x-mpeg", "audio/x-mpeg-3", "audio/mp3"],
    "AAC": ["audio/aac", "audio/x-aac", "audio/aacp", "video/mp2t", "audio/mp2t", "video/m2ts"],
    "M4A": ["audio/mp4", "audio/m4a", "audio/x-m4a"],
    "WAV": ["audio/wav", "audio/x-wav"],
    "FLAC": ["audio/flac", "audio/x-flac"],
    "PLS": ["audio/scpls", "audio/x-scpls", "application/pls+xml"],
    "M3U": ["audio/mpegurl", "audio/x-mpegurl"],
    "ASX": ["audio/ms-asf", "video/x-ms-asf", "audio/x-ms-asx"],
    "OGG": ["application/ogg", "audio/ogg"],
    "M3U8": ["application/vnd.apple.mpegurl", "application/hls+xml", "application/x-mpegurl"],
    "TXT": ["application/octet-stream", "application/asx", "video/asf", "text/html", "text/plain", "application/json"],
}
CODECS = ("MP3", "AAC", "M4A", "WAV", "FLAC", "OGG", "OPUS", "VORBIS")
PLAYLISTS = ("PLS", "M3U", "ASX", "M3U8")

# File extensions by codec.
EXTENSIONS = {"mp3": "MP3", "m4a": "M4A", "aac": "AAC", "wav": "WAV", "flac": "FLAC", "opus": "OGG", "ogg": "OGG", "oga": "OGG"}

# Labels of tag frames, of versions 2.2 and then 2.3 and 2.4.
TAGS = {
    "CNT": "Play counter", "COM": "Comments", "CRA": "Audio encryption", "CRM": "Encrypted meta frame", "ETC": "Event timing codes",
    "EQU": "Equalization", "IPL": "Involved people list", "PIC": "Attached picture", "SLT": "Synchronized lyric/text",
    "TAL": "Album/Movie/Show title", "TBP": "BPM (Beats Per Minute)", "TCM": "Composer", "TCO": "Content type", "TCR": "Copyright message",
    "TDA": "Date", "TDY": "Playlist delay", "TEN": "Encoded by", "TFT": "File type", "TIM": "Time", "TKE": "Initial key", "TLA": "Language(s)",
    "TLE": "Length", "TMT": "Media type", "TOA": "Original artist(s)/performer(s)", "TOF": "Original filename",
    "TOL": "Original Lyricist(s)/text writer(s)", "TOR": "Original release year", "TOT": "Original album/Movie/Show title",
    "TP1": "Lead artist(s)/Lead performer(s)/Soloist(s)/Performing group", "TP2": "Band/Orchestra/Accompaniment",
    "TP3": "Conductor/Performer refinement", "TP4": "Interpreted, remixed, or otherwise modified by", "TPA": "Part of a set", "TPB": "Publisher",
    "TRC": "ISRC (International Standard Recording Code)", "TRD": "Recording dates", "TRK": "Track number/Position in set", "TSI": "Size",
    "TSS": "Software/hardware and settings used for encoding", "TT1": "Content group description", "TT2": "Title/Songname/Content description",
    "TT3": "Subtitle/Description refinement", "TXT": "Lyricist/text writer", "TXX": "User defined text information frame", "TYE": "Year",
    "UFI": "Unique file identifier", "ULT": "Unsychronized lyric/text transcription", "WAF": "Official audio file webpage",
    "WAR": "Official artist/performer webpage", "WAS": "Official audio source webpage", "WCM": "Commercial information",
    "WCP": "Copyright/Legal information", "WPB": "Publishers official webpage", "WXX": "User defined URL link frame", "COMM": "Comment",
    "OWNE": "Ownership", "PRIV": "Private", "SYLT": "SynLyrics", "TALB": "Album", "TBPM": "BeatsPerMinute", "TCAT": "PodcastCategory",
    "TCMP": "Compilation", "TCOM": "Composer", "TCON": "ContentType", "TCOP": "Copyright", "TDAT": "Date", "TDES": "PodcastDescription",
    "TDOR": "Original Release Year", "TDRC": "Publication date", "TDRL": "ReleaseTime", "TENC": "Encoded by", "TGID": "PodcastID", "TIME": "Time",
    "TIT1": "Grouping", "TIT2": "Title", "TIT3": "Subtitle", "TLAN": "Language", "TLEN": "Length (ms)", "TMED": "Media", "TOAL": "OriginalAlbum",
    "TOPE": "OriginalArtist", "TOLY": "OriginalLyricist", "TORY": "OriginalReleaseYear", "TPE1": "Artist", "TPE2": "Band", "TPE3": "Conductor",
    "TPE4": "InterpretedBy", "TPOS": "PartOfSet", "TPUB": "Publisher", "TRCK": "Track", "TRSN": "InternetRadioStationName",
    "TSSE": "SettingsForEncoding", "TRDA": "RecordingDates", "TSO2": "AlbumArtistSortOrder", "TSOA": "AlbumSortOrder", "TSOP": "PerformerSortOrder",
    "TSOC": "ComposerSortOrder", "TSOT": "TitleSortOrder", "TXXX": "UserDefinedText", "TYER": "Year", "USER": "TermsOfUse", "USLT": "Lyrics",
    "WCOM": "Commercial URL", "WFED": "Podcast URL", "WOAF": "File URL", "WOAR": "OfficialArtistWebpage", "WOAS": "Source URL",
    "WORS": "InternetRadioStationURL", "WXXX": "User defined URL link frame", "XDOR": "OriginalReleaseTime",
}

# Labels of iTunes atoms.
ATOMS = {
    "©nam": "Title", "©ART": "Artist", "©art": "Artist", "©alb": "Album", "©too": "Encoder", "©cmt": "Comment", "©wrt": "Composer", "tmpo": "Tempo (BPM)",
    "trkn": "Track-Number", "©day": "Year", "cpil": "Compilation-Flag", "aART": "Album Artist", "©gen": "Genre", "covr": "Cover Art", "disk": "Disk-Nummer",
    "©lyr": "Songtext", "cprt": "Copyright", "gnre": "Genre-ID", "rtng": "Evaluation", "pgap": "Gapless Playback",
}


def mime_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, k) for k, of in MIME.items() for m in of], "mime string, kind string")


def tag_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAGS.items()), "tag string, label string")


def atom_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ATOMS.items()), "atom string, label string")


def events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENTS, "e int, s string")


def with_mime_kind(df: DataFrame, mime: str = "content_type") -> DataFrame:
    """Adds kind: codec, playlist format, TXT or null, of a content type without its parameters."""
    own = F.lower(F.trim(F.substring_index(F.col(mime), ";", 1)))
    return df.withColumn("_m", own).join(F.broadcast(mime_types(df.sparkSession).withColumnRenamed("mime", "_m")), "_m", "left").drop("_m")


def content_kind(kind: Column, mime: Column, expected: Column, hls_codec: Column) -> Column:
    """The final kind: what the URL led one to expect decides for general types, and the variant's codec for MPEG-TS.

    ``expected`` is a codec or playlist format, or null.
    """
    m = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    ts = (kind == "AAC") & m.isin("video/mp2t", "audio/mp2t") & (hls_codec == "MP3")
    hls = (expected == "M3U8") & (((kind == "M3U") & (m == "audio/mpegurl")) | ((kind == "TXT") & (m == "application/json")))
    told = F.when(expected.isin("AAC", "MP3", *PLAYLISTS), expected)
    return F.when(ts, "MP3").when(hls, "M3U8").when(kind == "TXT", told).otherwise(kind)


def with_tag_labels(df: DataFrame, tag: str = "tag") -> DataFrame:
    """Adds the label of a tag frame, null for unknown ones."""
    return df.join(F.broadcast(tag_labels(df.sparkSession).withColumnRenamed("tag", tag)), tag, "left")


def extension_codec(path: Column) -> Column:
    """Codec of a file name, null for others."""
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def url_expectation(url: Column) -> Column:
    """Codec or playlist format that a URL's path ends in."""
    end = F.lower(F.regexp_extract(F.substring_index(url, "?", 1), r"\.([A-Za-z0-9]+)$", 1))
    kinds = EXTENSIONS | {"asx": "ASX", "m3u": "M3U", "pls": "PLS", "m3u8": "M3U8"}
    return F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[end]
