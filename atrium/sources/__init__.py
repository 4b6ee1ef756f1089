"""Sources and sinks: point clouds, posed frames, scene documents and graphs."""
