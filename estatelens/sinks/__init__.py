"""Writers: table maintenance and graph exports."""
