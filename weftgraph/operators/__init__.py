"""Graph operators over ``nodes`` (id, type, name, file_path, line_start) and ``edges`` DataFrames."""
