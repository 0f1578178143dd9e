"""Around the engine: editor service, templates, demo tables, project overview."""
