"""Streams: the replay of turns as they arrive, and windowed counts under a watermark."""
