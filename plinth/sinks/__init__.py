"""Writers: JSON, CSV, Markdown, DOT, HTML, patches."""
