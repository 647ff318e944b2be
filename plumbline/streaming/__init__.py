"""An extension beyond batch audits: measuring files as they arrive."""
