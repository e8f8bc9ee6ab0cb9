"""Knobs of the playback pipeline, as frozen values that become literals in plans."""

from __future__ import annotations

from dataclasses import dataclass

# Event numbers and labels.
EVENTS = [
    (0, "info"), (1, "id3data"), (2, "eof"), (3, "station_name"), (4, "icy_description"), (5, "streamtitle"), (6, "bitrate (b/s)"), (7, "icy_url"),
    (8, "icy_logo"), (9, "genre"), (10, "lasthost"), (11, "cover_image"), (12, "lyrics"), (13, "log"), (14, "VU"), (15, "BANDS"),
]


@dataclass(frozen=True)
class Envelope:
    """Attack step, release step and hold cycles of a display."""

    attack: int
    release: int
    hold: int


@dataclass(frozen=True)
class Settings:
    """Defaults as documented; call ``checked`` for values from outside."""

    dma_desc_num: int = 16
    dma_frame_num: int = 256
    freq_low_hz: int = 500
    freq_peak_hz: int = 1800
    freq_high_hz: int = 6000
    slope: float = 0.707
    equalizer: bool = True
    vu_bars: Envelope = Envelope(200, 30, 1)
    vu_peak: Envelope = Envelope(200, 10, 2)
    spectrum_bars: Envelope = Envelope(100, 20, 1)
    spectrum_peak: Envelope = Envelope(200, 10, 2)
    vu_level: bool = False
    spectrum: bool = False
    volume_control: bool = True
    fading_speed: float = 50.0
    volume: int = 21
    volume_steps: int = 21
    balance: float = 0.0
    mute: bool = False
    force_mono: bool = False
    tone_db: tuple[float, float, float] = (0.0, 0.0, 0.0)
    output_rate: int | None = None

    @property
    def window(self) -> int:
        """Frames in a level meter window."""
        return self.dma_desc_num * self.dma_frame_num // 2

    def checked(self) -> Settings:
        if self.output_rate not in (None, 44_100, 48_000):
            raise ValueError("output rate: None, 44100 or 48000")
        if self.volume_steps < 21 or not 0 <= self.volume <= self.volume_steps:
            raise ValueError("volume steps: 21 and more; volume within them")
        if any(abs(g) > 12 for g in self.tone_db) or abs(self.balance) > 16:
            raise ValueError("tone: -12 to 12 dB; balance: -16 to 16")
        return self
