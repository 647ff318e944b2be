"""Where audits go: tables, JSON, CSV, HTML, PDF and thumbnails."""
