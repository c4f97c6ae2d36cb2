"""Reports, views and files of found matches."""
