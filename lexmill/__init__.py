"""lexmill: document and usage analytics as DataFrame programs."""
