"""Sources and sinks: reports, trajectories, paged Markdown, files with digests; tables as CSV and text."""
